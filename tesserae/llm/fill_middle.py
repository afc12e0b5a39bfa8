"""Fill-in-the-middle rearrangement of documents.

A text's token boundaries enter a compressed set (``boundaries.BoundarySet``), from
which both cut offsets are selected by number.  Cuts and form are drawn from a hash of
seed and id, so a run can be repeated row by row anywhere.  Texts are cut as bytes at
boundaries of characters, and every other count is of characters.

Defined results: a null text counts as empty; empty texts and those with a mark inside
stay plain; a null id is drawn as the seed with nothing behind it; repeated rows are
drawn alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.boundaries import BoundarySet

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_SCHEMA = "id {id}, n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass(frozen=True)
class Plan:
    """Seed, percentages of rearranged texts and of the suffix-first form among them, marks, and the unit of cuts."""

    seed: int = 42
    rearranged_percent: int = 50
    suffix_first_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "word"


def word_ends(data: np.ndarray) -> np.ndarray:
    """Ends of tokens: words with the white space before them, and white space at the end."""
    inside = ~_GAP[data]
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1 if len(data) else np.empty(0, np.int64)
    return np.concatenate([ends, [len(data)]]) if len(data) and not inside[-1] else ends


def character_ends(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([(data[1:] & 0xC0) != 0x80, [True]])) + 1 if len(data) else np.empty(0, np.int64)


UNITS = {"word": word_ends, "character": character_ends}


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _rearrange(plan: Plan):
    marks = [m.encode() for m in (plan.prefix, plan.suffix, plan.middle)]
    p, s, m = marks

    def one(body: bytes, key: str) -> tuple:
        data = np.frombuffer(body, np.uint8)
        ends = BoundarySet(UNITS[plan.unit](data))
        n = len(ends)
        digest = hashlib.sha256(f"{plan.seed}:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not body or h3 % 100 >= plan.rearranged_percent or any(x in body for x in marks):
            return n, "plain", None, None, body
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends.select(k - 1) if k else 0 for k in (low, high))
        head, tail, inner = body[:a], body[b:], body[a:b]
        suffix_first = h4 % 100 < plan.suffix_first_percent
        out = (s, tail, p, head, m, inner) if suffix_first else (p, head, s, tail, m, inner)
        return n, "spm" if suffix_first else "psm", _characters(data[:a]), _characters(data[a:b]), b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column("key").to_pylist(), batch.column("body")
            rows = [one(body.as_buffer().to_pybytes(), key) for body, key in zip(bodies, keys, strict=True)]
            n, form, head, inner, out = ([r[k] for r in rows] for k in range(5))
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(head, pa.int64()), pa.array(inner, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row; lengths are null for plain texts."""
    if plan.unit not in UNITS:
        raise ValueError(f"unknown unit {plan.unit}")
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"),
        F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("body"),
    )
    made = rows.mapInArrow(_rearrange(plan), _SCHEMA.format(id=rows.schema["id"].dataType.simpleString()))
    return made.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that ``output`` was made of.

    A rearranged text has no mark of its own, and no mark can arise across a seam, so each
    mark occurs once.
    """
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    inner = after(output, plan.middle)
    head = before(after(output, plan.prefix), plan.suffix)
    suffix_first = F.concat(before(after(output, plan.prefix), plan.middle), inner, before(after(output, plan.suffix), plan.prefix))
    prefix_first = F.concat(head, inner, before(after(output, plan.suffix), plan.middle))
    return F.when(form == "spm", suffix_first).when(form == "psm", prefix_first).otherwise(output)
