"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of labelled text.  A
text belongs to the language whose dictionary lets it compress to the fewest bytes;
it is rejected when the runner-up comes too close.  Texts are compressed whole, in
blocks, so that a long text keeps being compared with the dictionaries rather than
with its own beginning.

A dictionary is made of whole excerpts, in order of their texts' hashes, as long as they
fit into ``DICTIONARY_BYTES``; scripts of more bytes a character get fewer excerpts.

Defined results: a null text or one without a letter is ``und`` with score 0 and is
rejected; null labels are not learned from; with no labelled row every text is
``und``; ties go to the first language in order; repeated rows are judged alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.slices import slices

#: A model is fitted on so many different texts of each language at most, one excerpt of each.
SAMPLE_TEXTS = 400
EXCERPT_CHARS = 600
DICTIONARY_BYTES = 256 << 10
MAX_LANGUAGES = 200
#: Excerpts are chosen among so many parts of the labelled texts first, so that no task ranks a whole language.
PARTS = 64
LEVEL = 6
BLOCK_BYTES = 16 << 10
#: Rejected when the second-best size is not larger than the best by this share.
MIN_MARGIN = 0.004
#: Bytes of difference that divide the odds by e.
SCORE_BYTES = 8.0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample of labelled rows.

    Texts are ranked by their hash; copies count once.  What reaches the driver is at
    most ``SAMPLE_TEXTS * EXCERPT_CHARS`` characters a language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("body"))
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    hashes = rows.select("lang", F.xxhash64("body").alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h")) <= SAMPLE_TEXTS
    chosen = hashes.withColumn("in", first("lang", "part")).where("in").withColumn("in", first("lang")).where("in")
    start = F.pmod(F.col("h"), F.greatest(F.char_length("body") - EXCERPT_CHARS, F.lit(0)) + 1).cast("int") + 1
    found = (
        rows.withColumn("h", F.xxhash64("body"))
        .join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi")  # at most SAMPLE_TEXTS rows a language
        .select("lang", "h", F.lower(F.substr("body", start, F.lit(EXCERPT_CHARS))).alias("part"))
        .dropDuplicates(["lang", "h"])
    )
    excerpts: dict[str, list[tuple[int, str]]] = {}
    for row in found.collect():
        excerpts.setdefault(row["lang"], []).append((row["h"], row["part"]))
    return {name: dictionary([part for _, part in sorted(parts)]) for name, parts in sorted(excerpts.items())}


def dictionary(parts: list[str]) -> bytes:
    """Whole excerpts, one line each, as long as they fit."""
    out = bytearray()
    for part in parts:
        line = part.encode("utf-8", "surrogatepass")
        if len(out) + len(line) >= DICTIONARY_BYTES:
            break
        out += line + b"\n"
    return bytes(out)


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, model: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(model)
        self.coders = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=data, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def judge(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the text is rejected."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        body = text.lower().encode("utf-8", "surrogatepass")
        blocks = [body[i : i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        sizes = [sum(len(coder.compress(block)) for block in blocks) for coder in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        score = 1.0 / (1.0 + sum(math.exp(-min(700.0, (s - sizes[best]) / SCORE_BYTES)) for s in rest))
        return self.names[best], score, margin, margin < min_margin


def classify(docs: DataFrame, model: dict[str, bytes], text: str = "text", keep: dict[str, Column] | None = None, min_margin: float = MIN_MARGIN, body: str | None = None) -> DataFrame:
    """``lang_pred``, ``score``, ``margin`` and ``rejected`` beside the columns in ``keep``.

    ``body`` names the kept column that is the text, if it is kept, so that it travels once.
    Kept columns must not have the names of the new ones.  The dictionaries travel as one
    broadcast variable of bounded size.
    """
    kept = keep or {}
    if clash := {"lang_pred", "score", "margin", "rejected"} & set(kept):
        raise ValueError(f"kept columns named like new ones: {sorted(clash)}")
    extra = [] if body else [F.col(text).alias("_body")]
    body = body or "_body"
    rows = docs.select(*[c.alias(n) for n, c in kept.items()], *extra)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    count = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shipped.value)
        for batch in slices(batches, body):
            made = [classifier.judge(t.as_py(), min_margin) for t in batch.column(body)]
            names, scores, margins, rejected = zip(*made, strict=True) if made else ((), (), (), ())
            columns = [batch.column(i) for i in range(count)]
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + new, names=[*batch.schema.names[:count], "lang_pred", "score", "margin", "rejected"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:count]]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "margin double", "rejected boolean"]))


def fold(key: Column) -> Column:
    """The fold of a row: crc32 of its id as text, modulo 4."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(4))
