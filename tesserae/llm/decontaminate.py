"""Removal of benchmark passages with a generalised suffix automaton.

The normalised words of all test items enter one automaton: its states are the
strings of words that occur in items, and following suffix links gives the longest suffix
that still occurs.  A document's words are streamed through it; at each word the length of
the longest match ending there is known.  A match as long as a window makes its words
hit, and so does a whole item that is shorter than a window.  Which items have the window
is kept at the state that holds the match's last ``window`` words.

Automata are built in tasks, each of at most ``BLOCK_WORDS`` words; items that are longer
are cut into overlapping pieces, so no window is lost.  An automaton is broadcast only in
that bounded size.  Where items fill several, documents pass one after the other and carry
what they have found so far.

Defined results: null and wordless texts have no hits, and such items no windows; items
with one id count as one, an item without an id has an empty one; repeated rows are judged alike; with no
items nothing is hit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialise

WINDOW = 10
#: Words of items in one automaton: some 12 MB broadcast and 100 MB in a worker.
BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = "id {id}, {body}n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words_of(body: bytes) -> list[bytes]:
    """ASCII letters in lower case, digits, and all that is not ASCII."""
    return _WORD.findall(body.lower())


class Automaton:
    """Generalised suffix automaton of items' words, with the items that have a window ending in a state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: dict[str, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.pieces: list[tuple[int, list[int]]] = []
        self.words = 0

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state of its own for the suffixes of ``q`` that are one longer than ``p``."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        made = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return made

    def add(self, item: str, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.pieces.append((self.ids.setdefault(item, len(self.ids)), ids))
        self.words += len(ids)
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def packed(self) -> bytes:
        """All that ``Matcher`` needs, in arrays."""
        # The state that holds the last ``window`` words of a state's strings.
        holder = np.full(len(self.length), -1, np.int32)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= self.window:
                holder[v] = holder[up] if self.length[up] >= self.window else v
        windows: set[tuple[int, int]] = set()
        short: set[tuple[int, int, int]] = set()
        for item, ids in self.pieces:
            v = 0
            for i, w in enumerate(ids):
                v = self.next[v][w]
                if i + 1 >= self.window:
                    windows.add((int(holder[v]), item))
            if len(ids) < self.window:
                short.add((v, len(ids), item))
        many = len(self.vocabulary)
        moves = np.array([(v * many + w, t) for v, row in enumerate(self.next) for w, t in row.items()], np.int64).reshape(-1, 2)
        return pickle.dumps(
            {
                "window": self.window,
                "vocabulary": list(self.vocabulary),
                "ids": list(self.ids),
                "keys": moves[:, 0],
                "targets": moves[:, 1].astype(np.int32),
                "length": np.array(self.length, np.int32),
                "link": np.array(self.link, np.int32),
                "holder": holder,
                "windows": np.array(sorted(windows), np.int32).reshape(-1, 2),
                "short": np.array(sorted(short), np.int32).reshape(-1, 3),
            }
        )


class Matcher:
    """A packed automaton as a worker uses it."""

    def __init__(self, packed: bytes):
        a = pickle.loads(packed)
        self.window, self.ids = a["window"], a["ids"]
        self.word = {w: i for i, w in enumerate(a["vocabulary"])}
        self.many = len(self.word)
        self.moves = dict(zip(a["keys"].tolist(), a["targets"].tolist(), strict=True))
        self.length, self.link, self.holder = (a[x].tolist() for x in ("length", "link", "holder"))
        self.items: dict[int, list[int]] = {}
        for v, item in a["windows"].tolist():
            self.items.setdefault(v, []).append(item)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v, n, item in a["short"].tolist():
            self.short.setdefault(v, []).append((n, item))
        self.least = min([self.window, *(n for rows in self.short.values() for n, _ in rows)])

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, merged, and the items that have windows there."""
        word = self.word
        known = np.array([word.get(w, -1) for w in words], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known >= 0, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[int] = set()
        window, moves, link, length, many = self.window, self.moves, self.link, self.length, self.many
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin < self.least:
                continue
            v = n = 0
            for i, w in enumerate(known[begin:end].tolist(), begin + 1):
                t = moves.get(v * many + w)
                while t is None and v:
                    v = link[v]
                    n = length[v]
                    t = moves.get(v * many + w)
                if t is None:
                    continue
                v = t
                n += 1
                if n >= window:
                    states.add(self.holder[v])
                    if spans and spans[-1][0] == i - n:
                        spans[-1] = (i - n, i)
                    else:
                        spans.append((i - n, i))
                if self.short:
                    u = v
                    while u > 0:
                        for size, item in self.short.get(u, ()):
                            if size <= n:
                                items.add(item)
                                spans.append((i - size, i))
                        u = link[u]
        for v in states:
            items.update(self.items[v])
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of which none meet."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _pieces(window: int, size: int):
    """Words of items, long items in pieces that share ``window - 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts, sizes = [], [], []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body"), strict=True):
                words = words_of(body.as_buffer().to_pybytes())
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), size - window + 1):
                    part = words[at : at + size]
                    items.append(item)
                    texts.append(b" ".join(part))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["item", "body", "n"])

    return run


def _build(window: int, limit: int):
    """An automaton for every ``limit`` words that arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton(window)
        out = lambda a: pa.RecordBatch.from_arrays([pa.array([a.packed()], pa.binary())], names=["packed"])
        for batch in batches:
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = body.split(b" ")
                if made.words and made.words + len(words) > limit:
                    yield out(made)
                    made = Automaton(window)
                made.add(item, words)
        if made.words:
            yield out(made)

    return run


def automata(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Packed automata of all items, a row each."""
    if block_words < 2 * window:
        raise ValueError("an automaton must hold two windows at least")
    rows = items.where(F.col(f"`{text}`").isNotNull()).select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item"),
        F.encode(F.col(f"`{text}`"), "UTF-8").alias("body"),
    )
    pieces = materialise(rows.mapInArrow(_pieces(window, block_words), "item string, body binary, n long"), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    return materialise(pieces.repartition(max(-(-total // block_words), 1)).mapInArrow(_build(window, block_words), "packed binary"), "automata")


_LOADED: dict[int, Matcher] = {}


def _stream(shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is None:
            matcher = None
        else:
            if shared._jbroadcast_id not in _LOADED:
                _LOADED.clear()
                _LOADED[shared._jbroadcast_id] = Matcher(shared.value)
            matcher = _LOADED[shared._jbroadcast_id]
        for batch in batches:
            counts, spans, found = [], [], []
            for body, before, had in zip(batch.column("body"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = words_of(body.as_buffer().to_pybytes())
                own, items = matcher.match(words) if matcher else ([], set())
                counts.append(len(words))
                old = [(s["start"], s["stop"]) for s in before]
                spans.append([{"start": a, "stop": b} for a, b in (merged(old + own) if old else own)])
                found.append(sorted({*had, *(matcher.ids[i] for i in items)}))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [batch.column("id"), *([batch.column("body")] if with_text else []), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(["body"] if with_text else []), "n_words", "spans", "items"])

    return run


class _Shared:
    """A broadcast automaton with a name by which a worker knows that it has loaded it."""

    def __init__(self, broadcast, number: int):
        self._broadcast = broadcast
        self._jbroadcast_id = number

    @property
    def value(self) -> bytes:
        return self._broadcast.value


def find(docs: DataFrame, blocks: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``id, n_words, spans, items`` for every row: hit words as spans, and the items that have windows there.

    ``blocks`` comes from ``automata``; ``with_text`` adds the text in UTF-8 as ``body``.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("body"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    n = blocks.count()
    if not n:
        return state.mapInArrow(_stream(None, with_text), _FOUND.format(id=kind, body="body binary, " if with_text else ""))
    for i, row in enumerate(blocks.toLocalIterator()):
        last = i + 1 == n
        shared = context.broadcast(bytes(row["packed"]))
        body = with_text or not last
        made = state.mapInArrow(_stream(_Shared(shared, shared._jbroadcast.id()), body), _FOUND.format(id=kind, body="body binary, " if body else ""))
        # Each automaton takes a pass of its own, so that a worker holds one of them.
        state = made if last else materialise(made, "contaminated")
    return state


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, spans in zip(batch.column("body"), batch.column("cuts").to_pylist(), strict=True):
            raw = body.as_buffer().to_pybytes()
            if spans:
                places = [m.span() for m in _WORD.finditer(raw.lower())]
                parts, at = [], 0
                for s in spans:
                    parts.append(raw[at : places[s["start"]][0]])
                    at = places[s["stop"] - 1][1]
                raw = b"".join([*parts, raw[at:]])
            out.append(raw.decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "spans", "items", "dropped")), pa.array(out, pa.string())], names=["id", "n_words", "spans", "items", "dropped", "cleaned_text"])


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def remove(docs: DataFrame, blocks: DataFrame, key: str = "doc_id", text: str = "text", span_words: int = WINDOW, max_percent: float = 50.0) -> DataFrame:
    """What ``find`` gives, with ``cleaned_text``: without hit spans of ``span_words`` words or more.

    Documents of which more than ``max_percent`` of all words are hit are ``dropped``
    and keep no text.
    """
    found = find(docs, blocks, key, text, with_text=True)
    dropped = n_hit(F.col("spans")) * 100 > F.col("n_words") * max_percent
    whole = found.withColumn("dropped", dropped).withColumn("cuts", F.filter("spans", lambda s: s["stop"] - s["start"] >= span_words))
    kept = whole.withColumn("body", F.when(F.col("dropped"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("body"))).withColumn("cuts", F.when(~F.col("dropped"), F.col("cuts")))
    kind = docs.schema[key].dataType.simpleString()
    return kept.mapInArrow(_cut, _FOUND.format(id=kind, body="") + ", dropped boolean, cleaned_text string")
