"""SentencePiece BPE with seeded merge-dropout, and its lossless decoder.

A text is cut where no piece of the vocabulary reaches: before a run of spaces that
follows another character.  In each such word, candidate merges wait in an agenda by
score and position; one that comes up is skipped for good with the dropout rate, as
decided by a hash keyed by the seed, the record, the word's place in it and the number
of candidates that came up before.  With rate 0 the result is the library's own encoding.

The agendas of all words of a block are worked off side by side: in each turn the best
candidate of every word comes up, as array operations.  Words longer than ``LONG_WORD``
have a heap of their own; it comes to the same pieces.

Defined results: a null text counts as empty and has no pieces; a text's own U+2581
is written as bytes, so that it is told from a space; repeated rows with one key are
encoded alike; a null key counts as an empty one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
RATE = 0.1
#: Characters that are encoded together, to bound memory; a longer text is cut between words.
BLOCK_CHARS = 1 << 19
#: Words of more characters are worked off with a heap, whose cost does not grow with the square.
LONG_WORD = 64
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: Bits of a symbol's number: pieces first, then characters outside the vocabulary.
_SYMBOL = 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class PairTable:
    """Which symbol two symbols make, for whole arrays of them."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << _SYMBOL | b for a, b in pairs], np.int64)
        values = np.array([*pairs.values()], np.int64)
        self.levels: list[tuple[np.ndarray, np.uint64, np.uint64]] = []
        while len(keys):  # what meets a taken place goes to the next, smaller table
            bits = max(8, int(len(keys)).bit_length() + 3)
            factor, shift = _U(_STEP + 2 * len(self.levels)), _U(64 - bits)
            places = (keys.astype(_U) * factor >> shift).astype(np.int64)
            _, first = np.unique(places, return_index=True)
            made = np.full(1 << bits, -1, np.int64)
            made[places[first]] = keys[first] << _SYMBOL | values[first]
            self.levels.append((made, factor, shift))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << _SYMBOL | right
        out = np.full(len(key), -1, np.int32)
        for made, factor, shift in self.levels:
            entry = made[(key.view(_U) * factor >> shift).view(np.int64)]
            out = np.where(entry >> _SYMBOL == key, entry & ((1 << _SYMBOL) - 1), out)
        return out


class MergeDropout:
    def __init__(self, path: str, rate: float = RATE, seed: int = 0):
        import sentencepiece

        if not 0 <= rate < 1:
            raise ValueError("the rate must lie in [0, 1)")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_pieces = model.get_piece_size()
        if self.n_pieces + 0x110000 > 1 << _SYMBOL:
            raise ValueError(f"a vocabulary of more than {(1 << _SYMBOL) - 0x110000} pieces")
        ids: dict[str, int] = {}
        scores: dict[int, float] = {}
        self.byte_ids = np.zeros(256, np.int32)
        spelled: list[bytes] = []
        for i in range(self.n_pieces):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                spelled.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece reaches over a space")
                ids[piece], scores[i] = i, model.get_score(i)
                spelled.append(piece.replace(SPACE, " ").encode())
        # Behind all pieces come the same ones without a leading space, for a text's first piece.
        self.spelled = pa.array(spelled + [s[1:] if s[:1] == b" " else s for s in spelled], pa.large_binary())
        self.rate, self.seed = rate, seed
        self.least = round(rate * (1 << 64))
        places = {score: k for k, score in enumerate(sorted({-s for s in scores.values()}))}
        #: Ranks of pieces, the best first; the last entry is that of no piece.
        self.rank = np.full(self.n_pieces + 1, len(places), np.int64)
        for i, score in scores.items():
            self.rank[i] = places[-score]
        self.none = len(places)
        #: The symbol of each character.  A space is written as U+2581, the text's own is not a piece.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.n_pieces
        for piece, i in ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.symbol[ord(piece)] = i
        self.symbol[32] = ids.get(SPACE, self.n_pieces + 32)
        name = lambda part: ids.get(part, int(self.symbol[32 if part == SPACE else ord(part)]) if len(part) == 1 else None)
        self.pairs: dict[tuple[int, int], int] = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = name(piece[:k]), name(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self.table = PairTable(self.pairs)

    def skips(self, key: np.ndarray, turn: int) -> np.ndarray:
        """Whether candidate number ``turn`` is skipped in the words with these keys."""
        return _mixed(key + _U(_STEP * (turn + 1) & _ALL)) < _U(self.least)

    def _long_word(self, symbols: list[int], key: int) -> list[int]:
        """One word's symbols after its agenda is worked off, with a heap.

        Symbols are linked by place; an entry still stands if its two places hold the
        symbols that it was made for.
        """
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, rank = self.pairs, self.rank.tolist()
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            made = pairs.get((symbols[left], symbols[right]))
            if made is not None:
                heappush(agenda, (rank[made], left, right, symbols[left], symbols[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        turn = 0
        drawn: list[bool] = []
        while agenda:
            _, left, right, a, b = heappop(agenda)
            if symbols[left] != a or symbols[right] != b or after[left] != right:
                continue
            if self.least:
                if turn >= len(drawn):  # decisions are hashed in larger numbers
                    steps = (np.arange(turn, turn + 1024, dtype=_U) + _U(1)) * _U(_STEP)
                    drawn += (_mixed(_U(key) + steps) < _U(self.least)).tolist()
                turn += 1
                if drawn[turn - 1]:
                    continue
            symbols[left], symbols[right] = pairs[a, b], -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        out, at = [], 0
        while at < n:
            out.append(symbols[at])
            at = after[at]
        return out

    def _agendas(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that words end with, and how many each has."""
        words = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = self.rank << 32
        last = np.cumsum(sizes) - 1
        made = np.full(len(symbols), -1, np.int32)  # what a symbol makes with the next one
        inner = np.ones(len(symbols), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        made[at] = self.table.find(symbols[at], symbols[at + 1])
        for turn in itertools.count():
            if not len(sizes):
                break
            ends = np.cumsum(sizes)
            starts = ends - sizes
            best = np.minimum.reduceat(rank[made] | np.arange(len(made)), starts)
            live = best < self.none << 32
            lost = np.zeros(len(symbols), bool)
            if not live.all():
                over = ~live
                lost = np.repeat(over, sizes)
                done.append((words[over], sizes[over], symbols[lost]))
            at = best[live] & 0xFFFFFFFF
            starts, ends, sizes, words, keys = starts[live], ends[live], sizes[live], words[live], keys[live]
            if self.least:
                skipped = self.skips(keys, turn)
                made[at[skipped]] = -1
                merged = np.flatnonzero(~skipped)
                at, starts, ends = at[merged], starts[merged], ends[merged]
                sizes[merged] -= 1
            else:
                sizes -= 1
            symbols[at] = made[at]
            lost[at + 1] = True
            made[at] = -1
            right = at[at + 2 < ends]
            made[right] = self.table.find(symbols[right], symbols[right + 2])
            left = at[at > starts]
            made[left - 1] = self.table.find(symbols[left - 1], symbols[left])
            kept = np.flatnonzero(~lost)
            symbols, made = symbols[kept], made[kept]
        if not done:
            return symbols, sizes
        words, counts, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words)
        return flat[ranges((np.cumsum(counts) - counts)[order], counts[order])], counts[order]

    def _block(self, parts: list[str], records: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of parts of texts, their numbers, and the numbers of words.

        ``places`` are the words that come before a part in its text.
        """
        lengths = np.array([len(p) for p in parts], np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        own, blank = chars == ord(SPACE), chars == 32
        begins = np.zeros(len(chars), bool)
        begins[1:] = (blank[1:] & ~blank[:-1]) | own[1:] | own[:-1]
        ends = np.cumsum(lengths)
        begins[(ends - lengths)[lengths > 0]] = True
        first = np.flatnonzero(begins)
        sizes = np.diff(first, append=len(chars))
        # Words by part, and their keys.
        words = np.bincount(np.searchsorted(ends, first, "right"), minlength=len(parts)) if len(first) else np.zeros(len(parts), np.int64)
        number = np.arange(len(first)) - np.repeat(np.cumsum(words) - words, words) + np.repeat(places, words) + 1
        keys = _mixed(np.repeat(records, words) + number.astype(_U) * _U(_STEP))
        symbols = self.symbol[chars]
        long = np.flatnonzero(sizes > LONG_WORD)
        if len(long):
            short = sizes <= LONG_WORD
            flat, counts = self._agendas(symbols[np.repeat(short, sizes)], sizes[short], keys[short])
            own_way = [np.array(self._long_word(symbols[first[i] : first[i] + sizes[i]].tolist(), int(keys[i])), np.int32) for i in long]
            all_counts = np.zeros(len(sizes), np.int64)
            all_counts[short], all_counts[long] = counts, [len(x) for x in own_way]
            starts = np.zeros(len(sizes), np.int64)
            starts[short] = np.cumsum(counts) - counts
            starts[long] = len(flat) + np.cumsum(all_counts[long]) - all_counts[long]
            flat, counts = np.concatenate([flat, *own_way])[ranges(starts, all_counts)], all_counts
        else:
            flat, counts = self._agendas(symbols, sizes, keys)
        total = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(words)])]
        # Characters outside the vocabulary are written as bytes.
        char = flat - self.n_pieces
        odd = char >= 0
        if odd.any():
            width = np.where(odd, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
            grown = np.concatenate([[0], np.cumsum(width)])
            total = grown[total]
            where = np.flatnonzero(odd)
            flat = np.repeat(flat, width)
            text = b"".join(map(str.encode, map(chr, char[where].tolist()), itertools.repeat("utf-8"), itertools.repeat("surrogatepass")))
            flat[ranges(grown[where], width[where])] = self.byte_ids[np.frombuffer(text, np.uint8)]
        return flat, np.diff(total), words

    def encode_all(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and how many each has; the keys name the records."""
        records = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], _U)
        sizes = np.zeros(len(texts), np.int64)
        places = np.zeros(len(texts), np.int64)
        flats: list[np.ndarray] = []
        held: list[tuple[int, str]] = []
        room = BLOCK_CHARS

        def flush() -> None:
            nonlocal held, room
            at = [i for i, _ in held]
            flat, made, words = self._block([p for _, p in held], records[at], places[at])
            flats.append(flat)
            sizes[at] += made
            places[at] += words
            held, room = [], BLOCK_CHARS

        for i, text in enumerate(texts):
            rest = " " + text if text else ""
            while len(rest) > room:
                cut = rest.rfind(" ", 1, max(room, 2))
                while cut > 0 and rest[cut - 1] == " ":
                    cut -= 1
                if cut <= 0 and not held:  # no word ends before the room does
                    cut = rest.find(" ", max(room, 1))
                    while 0 < cut < len(rest) and rest[cut - 1] == " ":
                        cut = rest.find(" ", cut + 1)
                    cut = len(rest) if cut < 0 else cut
                if cut > 0:
                    held.append((i, rest[:cut]))
                    rest = rest[cut:]
                flush()
            if rest:
                held.append((i, rest))
                room -= len(rest)
        if held:
            flush()
        return np.concatenate([np.empty(0, np.int32), *flats]), sizes

    def encode(self, text: str, key: str) -> np.ndarray:
        """Piece ids of ``text``; ``key`` names the record."""
        return self.encode_all([text], [key])[0]

    def decode_all(self, flat: np.ndarray, sizes: np.ndarray) -> pa.LargeStringArray:
        """The texts of ids, without the space that encoding put in front."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = flat.astype(np.int64)
        flat[ends[:-1][sizes > 0]] += self.n_pieces
        made = self.spelled.take(pa.array(flat))
        offsets = np.frombuffer(made.buffers()[1], np.int64)[made.offset : made.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = made.buffers()[2] if len(flat) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets[ends].astype(np.int64)), data])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([len(ids)]))[0].as_py()


_CODERS: dict[tuple, MergeDropout] = {}


def coder(path: str, rate: float, seed: int) -> MergeDropout:
    if (path, rate, seed) not in _CODERS:
        _CODERS[path, rate, seed] = MergeDropout(path, rate, seed)
    return _CODERS[path, rate, seed]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", rate: float = RATE, seed: int = 0) -> DataFrame:
    """``key``, the whole ``text`` (null as empty) and its piece ``ids``."""
    rows = docs.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, rate, seed)
        for batch in batches:
            flat, sizes = own.encode_all(batch.column("_body").to_pylist(), [k or "" for k in batch.column("_name").to_pylist()])
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_body"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["_key", "_body", "ids"])

    kind = rows.schema["_key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"_key {kind}, _body string, ids array<int>")
    return made.withColumnsRenamed({"_key": key, "_body": text})


def decode(encoded: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``decoded``, the text that ``ids`` stand for."""
    rows = encoded.select(F.col(key).alias("_key"), F.col(text).alias("_body"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, RATE, 0)
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            made = own.decode_all(ids.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_body"), ids, made.cast(pa.string())], names=["_key", "_body", "ids", "decoded"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, _body string, ids array<int>, decoded string").withColumnsRenamed({"_key": key, "_body": text})
