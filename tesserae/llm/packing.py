"""Packing documents into sequences: best fit, then local search by swaps.

Documents are tokenized into pieces of at most one sequence.  Full pieces are
sequences of their own.  The others are dealt by hash into groups of bounded size;
each group is packed by best fit and then improved: bins exchange one piece for one,
two for one, or move a piece, whenever the sum of squared fills grows, which drains
the emptiest bins until they are gone.  What stays in badly filled bins of all groups
meets in a second, smaller round.

Defined results: a null or empty text is one piece that holds the end mark alone;
repeated rows are packed as often as they appear; an empty table gives no rows; other
columns are ignored; any number of equal lengths is packed alike.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.token_counts import byte_letters
from tesserae.session import materialise

CAPACITY = 2048
#: Pieces of a packing group, on average.
GROUP_PIECES = 20_000
#: Words whose ids one worker keeps.
CACHE_WORDS = 300_000
#: Texts that a worker holds as strings at once.
SLICE = 500
#: Bins filled less than this after the first round are packed again together.
REPACK_BELOW = 0.98

@dataclass(frozen=True)
class Effort:
    """How far the local search goes; it is a heuristic, and these decide where it gives up.

    ``share`` of the open bins, the emptiest first (``least`` of them at least), are worked
    on in each pass; ``pair_items`` of a bin's largest pieces make pairs for two-for-one
    exchanges; a partner that would keep more than ``rest`` tokens free is not taken; the
    search ends after ``idle`` passes that emptied no bin.
    """

    share: float = 0.25
    least: int = 16
    pair_items: int = 12
    rest: int = 64
    idle: int = 2


#: Fixed value: the pattern that splits lower-case text before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = b"\0"


def _letter_of(letters: dict[str, int], rank: int, end: str) -> str:
    letter = next(c for c, b in letters.items() if b == rank % 256)
    return letter if rank < 256 else letter + end


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, for a vocabulary that drops white space.

    Words between spaces and line ends are encoded one by one, which equals encoding
    the text, and remembered.  Words of Latin letters, digits and signs are merged by
    a byte-pair coder that holds the file's merges, many in one call; others go to the
    library that reads the file.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        end = model["end_of_word_suffix"]

        def spelled(token: str) -> bytes:
            # The end of a word is a byte that the words in question don't hold.
            body, tail = (token[: -len(end)], _END) if token.endswith(end) else (token, b"")
            return bytes(letters[c] for c in body) + tail

        # Ranks: bytes, then bytes that end a word, then the merges in the file's order.
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256)}
        for i, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(spelled(left) + spelled(right), 512 + i)
        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        last = np.zeros(len(ids), bool)
        for token, number in model["vocab"].items():
            try:
                rank = ranks.get(spelled(token))
            except KeyError:  # a special token, not spelled in the stand-ins for bytes
                continue
            if rank is not None and (rank >= 512 or token == _letter_of(letters, rank, end)):
                ids[rank] = number
                last[rank] = token.endswith(end)
        self.ids, self.last = ids, last
        self.coder = tiktoken.Encoding("words", pat_str="[^\0]*\0", mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile("[!-~\u00a1-\u024f]+").fullmatch
        self.split = regex.compile(WORDS).findall

    def _learn(self, new: list[str]) -> None:
        known = self.words
        plain, other = [], []
        for word in new:
            (plain if self.plain(word) and "<|" not in word else other).append(word)
        parts = [self.split(unicodedata.normalize("NFC", w).lower()) for w in plain]
        made = np.array(self.coder.encode_ordinary("\0".join([p for part in parts for p in part] + [""])), np.int64)
        ends = np.flatnonzero(self.last[made]) + 1
        stops = np.concatenate([[0], ends])[np.cumsum([len(p) for p in parts], dtype=np.int64)] if parts else []
        data = self.ids[made].astype("<u4").tobytes()
        at = 0
        for word, stop in zip(plain, stops, strict=True):
            known[word] = data[4 * at : 4 * int(stop)]
            at = int(stop)
        if other:
            for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                known[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        self._learn([w for w in dict.fromkeys(words) if w not in known])
        return b"".join([known[w] for w in words])


_ENCODERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece of every text."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    mark = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = WordIds(vocabulary)
        encode = _ENCODERS[vocabulary].encode
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            bodies = batch.column("_body")
            for low in range(0, len(bodies), SLICE):
                for i, body in enumerate(bodies.slice(low, SLICE).to_pylist(), low):
                    ids = encode(body) + mark
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        at.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_key", "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_key", key)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= size
        if left:
            open_[left].append(b)
            mask |= 1 << left
    return bins


class _Search:
    """Bins that are not full, found by what is left and by item size plus what is left."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int, effort: Effort):
        self.sizes, self.bins, self.capacity, self.effort = sizes, bins, capacity, effort
        self.left = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.swaps: list[set[tuple[int, int]]] = [set() for _ in range(capacity + 1)]
        self.room_mask = self.swap_mask = 0
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        left = self.left[b]
        if not left or not self.bins[b]:
            return
        self.room[left].add(b)
        self.room_mask |= 1 << left
        for i in self.bins[b]:
            self.swaps[self.sizes[i] + left].add((b, i))
            self.swap_mask |= 1 << (self.sizes[i] + left)

    def _leave(self, b: int) -> None:
        left = self.left[b]
        if not left or not self.bins[b]:
            return
        self.room[left].discard(b)
        if not self.room[left]:
            self.room_mask &= ~(1 << left)
        for i in self.bins[b]:
            slot = self.swaps[self.sizes[i] + left]
            slot.discard((b, i))
            if not slot:
                self.swap_mask &= ~(1 << (self.sizes[i] + left))

    def _change(self, a: int, give: tuple[int, ...], b: int, take: tuple[int, ...]) -> None:
        self._leave(a)
        self._leave(b)
        moved = sum(self.sizes[i] for i in give) - sum(self.sizes[i] for i in take)
        self.bins[a] = [i for i in self.bins[a] if i not in give] + list(take)
        self.bins[b] = [i for i in self.bins[b] if i not in take] + list(give)
        self.left[a] += moved
        self.left[b] -= moved
        self._enter(a)
        self._enter(b)

    def _partner(self, a: int, size: int) -> tuple[int, int] | None:
        """An item smaller than ``size`` in a fuller bin that would take ``size`` for it, filling best."""
        fill = self.capacity - self.left[a]
        at = size
        while at <= self.capacity:
            later = self.swap_mask >> at
            if not later:
                return None
            at += (later & -later).bit_length() - 1
            for b, i in self.swaps[at]:
                gain = size - self.sizes[i]
                if b != a and gain > 0 and self.capacity - self.left[b] + gain > fill:
                    return b, i
            at += 1
            if at - size > self.effort.rest:  # what is left over would outweigh the gain
                return None
        return None

    def improve(self, a: int) -> bool:
        """One exchange that moves tokens out of bin ``a`` into a fuller one."""
        fill = self.capacity - self.left[a]
        own = sorted(self.bins[a], key=lambda i: -self.sizes[i])
        for i in own:  # move
            size = self.sizes[i]
            at = size
            while later := self.room_mask >> at:
                at += (later & -later).bit_length() - 1
                b = next((b for b in self.room[at] if b != a), None)
                if b is not None and self.capacity - at + size > fill:
                    self._change(a, (i,), b, ())
                    return True
                at += 1
                if at > self.capacity:
                    break
        for i in own:  # one for one
            if found := self._partner(a, self.sizes[i]):
                self._change(a, (i,), found[0], (found[1],))
                return True
        short = own[: self.effort.pair_items]  # two for one
        for x in range(len(short)):
            for y in range(x + 1, len(short)):
                pair = self.sizes[short[x]] + self.sizes[short[y]]
                if pair <= self.capacity and (found := self._partner(a, pair)):
                    self._change(a, (short[x], short[y]), found[0], (found[1],))
                    return True
        return False


def local_search(sizes: list[int], bins: list[list[int]], capacity: int, effort: Effort = Effort()) -> list[list[int]]:
    """Empties the worst bins by exchanges that each raise the sum of squared fills."""
    need = -(-sum(sizes) // capacity)
    if len(bins) <= need:
        return bins
    state = _Search(sizes, bins, capacity, effort)
    alive = sum(1 for b in state.bins if b)
    idle = 0
    while alive > need and idle < effort.idle:
        before = alive
        worst = sorted((b for b in range(len(state.bins)) if state.bins[b] and state.left[b]), key=lambda b: -state.left[b])
        for b in worst[: max(effort.least, int(len(worst) * effort.share))]:
            steps = 0
            while state.bins[b] and steps < 4 * capacity and state.improve(b):
                steps += 1
            if not state.bins[b]:
                alive -= 1
                if alive <= need:
                    break
        idle = idle + 1 if alive == before else 0
    return [b for b in state.bins if b]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, effort: Effort = Effort()) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, capacity), capacity, effort)


def _pack_group(capacity: int, effort: Effort):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "_key", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        bins = pack_sizes(sizes, capacity, effort)
        sequence, offset, fill = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for number, items in enumerate(bins):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = number, at
                at += sizes[i]
            for i in items:
                fill[i] = at
        return rows.assign(_bin=sequence, offset=offset, _fill=fill)

    return run


def pack(made: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, effort: Effort = Effort()) -> DataFrame:
    """``sequence_id`` and ``offset`` for the pieces in ``made``, which should be a written table."""
    short = made.where(F.col("length") < capacity)
    n = short.count()
    groups = max(1, math.ceil(n / group_pieces))
    kind = made.schema[key].dataType.simpleString()
    columns = f"_h long, _group int, _key {kind}, piece int, start long, length long, ids_crc32 long"
    keyed = short.select(
        F.xxhash64(key, "piece", "ids_crc32").alias("_h"),
        F.lit(0).alias("_group"),
        F.col(key).alias("_key"),
        "piece",
        "start",
        "length",
        "ids_crc32",
    )
    # Rows that repeat one another in full are spread by their order, or a group could be unbounded.
    first = keyed.withColumn("_group", F.pmod(F.xxhash64("_h", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    packed = materialise(
        first.groupBy("_group").applyInPandas(_pack_group(capacity, effort), f"{columns}, _bin long, offset long, _fill long"),
        "packed",
    )
    loose = F.col("_fill") < capacity * REPACK_BELOW
    again = packed.where(loose)
    m = again.count()
    bins_again = max(1, math.ceil(m / group_pieces))
    second = again.drop("_bin", "offset", "_fill").withColumn("_group", F.pmod(F.xxhash64("_h", "_group", F.lit(1)), F.lit(bins_again)).cast("int"))
    repacked = second.groupBy("_group").applyInPandas(_pack_group(capacity, effort), f"{columns}, _bin long, offset long, _fill long")
    # Numbers: two of every four belong to the rounds, one to full pieces.
    number = lambda base, group, b: (F.shiftleft(group.cast("long"), 34) + b) * 4 + base
    out = ["_key", "piece", "start", "length", "ids_crc32"]
    kept = packed.where(~loose).select(*out, number(0, F.col("_group"), F.col("_bin")).alias("sequence_id"), "offset")
    moved = repacked.select(*out, number(1, F.col("_group"), F.col("_bin")).alias("sequence_id"), "offset")
    full = made.where(F.col("length") >= capacity).select(
        F.col(key).alias("_key"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return kept.unionByName(moved).unionByName(full).withColumnRenamed("_key", key)


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, effort: Effort = Effort()) -> DataFrame:
    made = materialise(pieces(docs, vocabulary, key, text, capacity), "pieces")
    return pack(made, key, capacity, group_pieces, effort)
