"""Exact deduplication by sorting content.

Splitters sampled by Spark's range partitioning deal the normalised texts out, each
partition is sorted externally, and neighbours are compared in full.  The order is by the
first ``HEAD_CHARS`` characters, then by a hash that divides the many texts with one
beginning (and keeps the splitters that reach the driver short), then by the whole text.

Before the texts travel, the copies in one Arrow batch are combined into one row: text,
ids, best id and count, under a tag.  So a group with a third of all rows is sent once per
batch.  The sorted runs give each tag its group's keeper and size, and the tag, which is
unique, brings them back to the ids; no key is ever hot and no list of a group's members
is built.

Defined results: a null text counts as the empty text; a null id never stays while
another one is there; rows that repeat an id with the same text are one document in
all but ``group_size``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.slices import slices
from tesserae.session import materialise, release

#: Characters of a text that take part in its splitters.
HEAD_CHARS = 32

NORMALISERS: dict[str, Callable[[Column], Column]] = {
    "none": lambda c: c,
    "space": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
    "lower_space": lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))),
}


def _combine_batches(keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    best = max if keep == "max" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bodies, ids = batch.column("body"), batch.column("id").to_pylist()
            known: dict[int, list[int]] = {}  # first rows of the different texts of each hash
            copies: dict[int, list[int]] = {}  # ids by first row
            for i, body in enumerate(bodies):
                rows = known.setdefault(xxhash.xxh3_64_intdigest(body.as_buffer()), [])
                first = next((k for k in rows if bodies[k].equals(body)), i)
                if first == i:
                    rows.append(i)
                copies.setdefault(first, []).append(ids[i])
            del bodies
            rest = batch.filter(pa.array([i in copies for i in range(batch.num_rows)])) if len(copies) < batch.num_rows else batch
            members = list(copies.values())
            del batch
            at = 0
            for part in slices(iter([rest]), "body"):
                own = members[at : at + part.num_rows]
                at += part.num_rows
                chosen = [best((x for x in m if x is not None), default=None) for m in own]
                yield pa.RecordBatch.from_arrays(
                    [part.column("body"), pa.array(own, pa.list_(pa.int64())), pa.array(chosen, pa.int64()), pa.array(map(len, own), pa.int64())],
                    names=["body", "ids", "best", "n"],
                )

    return run


def combine_copies(rows: DataFrame, keep: str) -> DataFrame:
    """``tag``, ``body``, ``ids``, ``best`` and ``n`` for the different texts of each Arrow batch, as a written table."""
    partial = rows.select("body", "id").mapInArrow(_combine_batches(keep), "body string, ids array<long>, best long, n long")
    return materialise(partial.withColumn("tag", F.monotonically_increasing_id()), "copies")


def sorted_groups(copies: DataFrame, keep: str = "max") -> DataFrame:
    """``tag``, ``keep_id``, ``group_size`` and ``digest`` of every row of ``copies``, from its sorted runs."""
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = copies.select("tag", "body", "best", "n", F.left("body", F.lit(HEAD_CHARS)).alias("head"), F.xxhash64("body").alias("h"))
    runs = keyed.repartitionByRange(parts, "head", "h")
    best = F.max if keep == "max" else F.min
    # The range partitioning serves this window without another exchange: its sort puts equal
    # texts side by side, and it compares each row's whole text with its neighbour's.
    equal = Window.partitionBy("head", "h", "body")
    return runs.select("tag", best("best").over(equal).alias("keep_id"), F.sum("n").over(equal).alias("group_size"), F.sha2("body", 256).alias("digest"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: str = "none", keep: str = "max") -> DataFrame:
    """Every document with the id that stays for its text, the group's size and the digest."""
    if keep not in ("max", "min"):
        raise ValueError("keep must be max or min")
    body = NORMALISERS[normalise](F.coalesce(F.col(text), F.lit("")))
    copies = combine_copies(docs.select(F.col(key).cast("long").alias("id"), body.alias("body")), keep)
    judged = copies.select("tag", "ids").join(sorted_groups(copies, keep), "tag")
    out = judged.select(F.explode("ids").alias("id"), "keep_id", "group_size", "digest").select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    made = materialise(out, "exact_groups")  # without the texts, so that their table can go
    release(copies)
    return made
