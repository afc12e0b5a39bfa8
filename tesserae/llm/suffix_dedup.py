"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

Which suffixes are indexed is decided by content: in every window of ``LENGTH`` bytes
the ``GRAM``-byte string with the least hash is its anchor, so equal windows have equal
anchors at equal offsets, and each anchor stands for a run of windows.  A batch of
documents gets an array of its anchors' suffixes in order (first bytes, then a hash of
the gram that resolves longer ties), each with how often it occurs.  The array is merge-scanned against the arrays of
all levels; suffixes that meet an equal gram are marked.  Then the batch enters level
0, and two arrays of one level merge into one of the next, so n batches leave about
log2(n) arrays and every suffix is rewritten that often.

Marked anchors are resolved exactly.  An anchor whose whole segment (the bytes of all
its windows) occurs elsewhere has every window repeated, as told by two hashes of 64 bits.
For the rest the windows themselves are compared within the anchor's group: their hashes
bring equal ones together and their bytes decide.  Windows of a group with more than
``SPLIT_SEGMENTS`` different segments are dealt out and counted by hashes of 128 bits.

An array holds suffixes by their first bytes and a hash, not by position and whole bytes:
with the bytes of all grams, writing and merging the levels would take several times the
input on disk.

A row is known by its id and a hash of its text, so rows that share an id are documents of
their own.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` bytes keep
all of it; rows that repeat an id with the same text are copies of one another and lose
the same bytes, and with other texts they are told apart; rows without an id take no part and are
returned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bytehash
from tesserae.llm.hot import join_unique, keep_known
from tesserae.session import drop_path, materialise, release, scratch_path

_U = np.uint64
LENGTH = 400
GRAM = 100
#: Batches in which a whole table enters the index.
BATCHES = 4
#: Groups with more different segments than this aren't held in one task.
SPLIT_SEGMENTS = 4096
_POSITION = (1 << 24) - 1
_ENTRY = "id long, row long, place long, head long, gram long, segment long"
#: A place holds the first start of an anchor's windows above 32 bits, the last one and the anchor as distances of 16 bits.
_LOW, _HIGH, _AT = "shiftright(place, 32)", "shiftright(place, 32) + (shiftright(place, 16) & 65535L)", "shiftright(place, 32) + (place & 65535L)"


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of a text with the first and the last start of the windows that they stand for.

    Long texts are walked in blocks; an anchor may then appear once for each block,
    with its own part of the windows.
    """
    width = length - gram + 1
    total = len(data) - length + 1
    for begin in range(0, max(total, 0), bytehash.BLOCK):
        n = min(bytehash.BLOCK, total - begin)
        hashes = bytehash.mix(bytehash.window_hashes(data[begin : begin + n + length - 1], gram))
        ranked = (hashes & ~_U(_POSITION)) | np.arange(len(hashes), dtype=_U)
        # Least value of each run of ``width``: from the left and from the right of blocks that wide.
        padded = np.concatenate([ranked, np.full(-len(ranked) % width, 2**64 - 1, _U)]).reshape(-1, width)
        forward = np.minimum.accumulate(padded, axis=1).ravel()
        backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        own = np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & _U(_POSITION)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        yield own[first].astype(np.int64) + begin, first + begin, last + begin


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.encode(F.col(f"`{text}`"), "UTF-8")
    return docs.where(F.col(f"`{key}`").isNotNull()).select(row_id(F.col(f"`{key}`")).alias("id"), row_hash(F.col(f"`{text}`")).alias("row"), body.alias("body"))


def row_id(key: Column) -> Column:
    return key.cast("long")


def row_hash(text: Column) -> Column:
    """Tells rows with one id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def entries(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each anchor: row, place, first eight bytes, gram and segment hash."""
    if length >= 1 << 15:
        raise ValueError("passages must be shorter than 32 KiB")
    rows = _keyed(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row", "place", "head", "gram", "segment"]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            ids, hashes, places, heads, grams, segments = columns
            for key_, row, value in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), batch.column("body"), strict=True):
                if not value.is_valid:
                    continue
                body = value.as_buffer().to_pybytes()
                if len(body) < length:
                    continue
                for at, low, high in anchors(np.frombuffer(body, np.uint8), length, gram):
                    places += (low << 32 | (high - low) << 16 | (at - low)).tolist()
                    at, low, high = at.tolist(), low.tolist(), high.tolist()
                    ids += [key_] * len(at)
                    hashes += [row] * len(at)
                    heads += [int.from_bytes(body[a : a + min(8, gram)], "big", signed=gram >= 8) for a in at]
                    grams += [_signed(xxhash.xxh3_64_intdigest(body[a : a + gram])) for a in at]
                    segments += [_signed(xxhash.xxh3_64_intdigest(body[lo : hi + length], a - lo)) for a, lo, hi in zip(at, low, high, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.mapInArrow(run, _ENTRY)


class SuffixIndex:
    """Levels of sorted suffix arrays in the shared folder, each about twice the one below."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, str] = {}
        self.marked: list[str] = []

    def _array(self, path: str) -> DataFrame:
        return self.spark.read.schema("head long, gram long, n long").parquet(path)

    def _write(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark, "suffixes")
        rows.groupBy("head", "gram").agg(F.sum("n").alias("n")).sortWithinPartitions("head", "gram").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        """Indexes the suffixes in ``batch`` (rows of ``entries``) and marks what repeats."""
        path = self._write(batch.select("head", "gram", F.lit(1).cast("long").alias("n")))
        array = self._array(path)
        found = array.where("n > 1")
        for level in self.levels.values():
            # Both sides are sorted by suffix and scanned together.
            known = self._array(level).withColumnRenamed("n", "before")
            found = found.union(array.join(known.hint("merge"), ["head", "gram"]).select("head", "gram", F.col("n") + F.col("before")))
        hits = scratch_path(self.spark, "marked")
        found.write.parquet(hits)
        self.marked.append(hits)
        level = 0
        while level in self.levels:
            below = self.levels.pop(level)
            merged = self._write(self._array(below).union(self._array(path)))
            drop_path(self.spark, below)
            drop_path(self.spark, path)
            path, level = merged, level + 1
        self.levels[level] = path

    def repeated(self) -> DataFrame:
        """The suffixes (by first bytes and gram) that occur twice or more among all batches, and about how often."""
        return self.spark.read.schema("head long, gram long, n long").parquet(*self.marked).groupBy("head", "gram").agg(F.sum("n").alias("n"))

    def close(self) -> None:
        for path in [*self.levels.values(), *self.marked]:
            drop_path(self.spark, path)
        self.levels, self.marked = {}, []


def again(held: list[tuple[int, np.ndarray, bytes]], length: int) -> list[np.ndarray]:
    """Which windows of each member occur twice or more among all; a member has a group, hashes of its windows and bytes."""
    hashes = np.concatenate([h[1] for h in held])
    base = np.cumsum([0, *(len(h[1]) for h in held)])
    _, first, inverse, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    last = np.zeros(len(n), np.int64)
    last[inverse] = np.arange(len(hashes))
    at = np.arange(len(hashes))
    partner = np.where(first[inverse] == at, last[inverse], first[inverse])
    repeated = n[inverse] > 1
    # Bytes decide: runs of windows whose partners are a run too are compared at once.
    theirs = np.searchsorted(base, partner, "right") - 1
    mine = np.searchsorted(base, at, "right") - 1
    starts = np.flatnonzero(repeated & ~np.concatenate([[False], repeated[:-1] & (mine[1:] == mine[:-1]) & (theirs[1:] == theirs[:-1]) & (partner[1:] == partner[:-1] + 1)]))
    ends = np.flatnonzero(repeated & ~np.concatenate([repeated[1:] & (mine[1:] == mine[:-1]) & (theirs[1:] == theirs[:-1]) & (partner[1:] == partner[:-1] + 1), [False]]))
    for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
        a, b = held[mine[x]], held[theirs[x]]
        p, q = x - int(base[mine[x]]), int(partner[x] - base[theirs[x]])
        if a[0] != b[0] or a[2][p : p + y - x + length] != b[2][q : q + y - x + length]:
            break
    else:
        return np.split(repeated, base[1:-1])
    # Two different windows with one hash: count the windows themselves.
    seen: dict[tuple[int, bytes], int] = {}
    for g, own, body in held:
        for k in range(len(own)):
            window = (g, body[k : k + length])
            seen[window] = seen.get(window, 0) + 1
    return [np.array([seen[g, body[k : k + length]] > 1 for k in range(len(own))], bool) for g, own, body in held]


_SPANS = "id long, row long, start long, stop long"


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["id", "row", "start", "stop"])


def _repeated_windows(length: int):
    """From rows of groups in order, the repeated windows of segments that occur once.

    Rows arrive sorted by gram; a group that goes on in the next Arrow batch waits for it.
    """

    def flush(held: list[tuple], own: list[tuple]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        for (id_, row, low, single), mine in zip(own, again(held, length) if held else [], strict=True):
            if single and mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                out += [(id_, row, low + int(a), low + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return _spans(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        own: list[tuple] = []
        last, windows = None, 0
        for batch in batches:
            get = lambda name, b=batch: b.column(name).to_pylist()
            for g, id_, row, at, low, high, count, body in zip(*map(get, ("gram", "id", "row", "at", "low", "high", "count", "body")), strict=True):
                # Small groups are resolved together: their hashes differ by gram.
                if g != last and windows > 200_000:
                    yield flush(held, own)
                    held, own, windows = [], [], 0
                last = g
                hashes = bytehash.window_hashes(np.frombuffer(body, np.uint8), length)
                offset = at - np.arange(low, high + 1)
                keys = bytehash.mix(bytehash.mix(hashes, 3) ^ bytehash.mix(np.full(len(offset), g, np.int64).view(_U) + offset.astype(_U) * _U(0x9E3779B97F4A7C15), 5))
                held.append((g, keys, body))
                own.append((id_, row, low, count == 1))
                windows += len(keys)
        yield flush(held, own)

    return run


def _every_window(length: int):
    """A row for each window of segments in very large groups: two hashes, its text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name, b=batch: b.column(name).to_pylist()
            for id_, row, low, high, count, body in zip(*map(get, ("id", "row", "low", "high", "count", "body")), strict=True):
                digests = b"".join(xxhash.xxh3_128_digest(body[k : k + length]) for k in range(high - low + 1))
                pairs = np.frombuffer(digests, np.int64).reshape(-1, 2)
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(n, id_)), pa.array(np.full(n, row)), pa.array(np.arange(low, high + 1)), pa.array(np.full(n, count))],
                    names=["k1", "k2", "id", "row", "start", "count"],
                )

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """``(id, row, start, stop)`` of repeated bytes, overlapping as they may; and the texts of the documents concerned."""
    spark = docs.sparkSession
    path = scratch_path(spark, "entries")
    made = entries(docs, key, text, length, gram)
    made.withColumn("batch", F.pmod(F.xxhash64("id", "row"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    every = spark.read.schema(_ENTRY + ", batch int").parquet(path)
    index = SuffixIndex(spark)
    for i in range(batches):
        index.add(every.where(F.col("batch") == i))
    suffixes = materialise(index.repeated(), "suffixes")
    index.close()
    marked = materialise(keep_known(every.drop("batch"), suffixes, ["head", "gram"], "n").drop("head"), "repeated")
    drop_path(spark, path)
    release(suffixes)
    one = F.struct("id", "row", "place")
    segments = materialise(marked.groupBy("gram", "segment").agg(F.count(F.lit(1)).alias("count"), F.min(one).alias("one")), "segments")
    groups = materialise(segments.groupBy("gram").agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("size")), "groups")
    # Equal segments elsewhere: all windows are repeated.
    twice = segments.where("count > 1").select("gram", "segment", "count")
    whole = keep_known(marked, twice, ["gram", "segment"], "count").select("id", "row", F.expr(_LOW).alias("start"), (F.expr(_HIGH) + length).alias("stop"))
    # Groups with a segment that occurs once are opened, one row for each different segment.
    opened = join_unique(segments, groups, ["gram"], "size", ["segment"]).where("least = 1 and size > 1").select("gram", "size", "count", "one.*")
    places = opened.select("id", "row", "gram", "size", "count", F.expr(_AT).alias("at"), F.expr(_LOW).alias("low"), F.expr(_HIGH).alias("high"))
    lists = places.groupBy("id", "row").agg(F.collect_list(F.struct("gram", "size", "count", "at", "low", "high")).alias("open"))
    ids = marked.select("id", "row").distinct().join(lists, ["id", "row"], "left")
    texts = materialise(_keyed(docs, key, text).join(ids, ["id", "row"]), "texts")
    rows = texts.select("id", "row", "body", F.explode("open").alias("o")).select(
        "o.gram",
        "o.size",
        "o.count",
        "id",
        "row",
        "o.at",
        "o.low",
        "o.high",
        F.expr(f"substring(body, cast(o.low as int) + 1, cast(o.high - o.low as int) + {length})").alias("body"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where(F.col("size") <= SPLIT_SEGMENTS).repartition(n, "gram").sortWithinPartitions("gram")
    some = whole.union(ordered.mapInArrow(_repeated_windows(length), _SPANS))
    if not groups.where((F.col("size") > SPLIT_SEGMENTS) & (F.col("least") == 1)).isEmpty():
        large = rows.where(F.col("size") > SPLIT_SEGMENTS).select("id", "row", "low", "high", "count", "body")
        windows = materialise(large.mapInArrow(_every_window(length), "k1 long, k2 long, id long, row long, start long, count long"), "windows")
        counts = materialise(windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "counts")
        found = keep_known(windows.where("count = 1"), counts, ["k1", "k2"], "times")
        some = some.union(found.select("id", "row", "start", (F.col("start") + length).alias("stop")))
    return some, texts.select("id", "row", "body")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for value, found in zip(batch.column("body"), batch.column("found").to_pylist(), strict=True):
            body = value.as_buffer().to_pybytes()
            parts, at, runs, gone = [], 0, 0, 0
            merged: list[list[int]] = []
            for start, stop in sorted((f["start"], f["stop"]) for f in found or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            for start, stop in merged:
                parts.append(body[at:start])
                gone += stop - start
                runs += 1
                at = stop
            parts.append(body[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(runs)
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(digests, pa.string())],
            names=["id", "row", "n_removed", "n_spans", "kept_text", "kept_sha256"],
        )


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``id, row, n_removed, n_spans``, ``kept_text`` and the digest of its bytes, for rows that lose any, by ``row_id`` and ``row_hash``.

    The digest is of all bytes kept; ``kept_text`` lacks characters of which a part was cut.
    """
    found, texts = repeats(docs, key, text, length, gram, batches)
    lists = found.groupBy("id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    return texts.join(lists, ["id", "row"]).select("id", "row", "body", "found").mapInArrow(_cut, "id long, row long, n_removed long, n_spans long, kept_text string, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """Sizes, removed bytes and runs, and the digest of what is kept, for every document."""
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    base = docs.select(F.col(f"`{key}`").alias("_key"), row_id(F.col(f"`{key}`")).alias("id"), row_hash(F.col(f"`{text}`")).alias("row"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("_digest"))
    lost = cut(docs, key, text, **options).drop("kept_text").dropDuplicates(["id", "row"])
    out = base.join(lost, ["id", "row"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(F.col("_key").alias(key), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "_digest").alias("kept_sha256"))
