"""Exact token counts of every prefix by dynamic programming over byte-level BPE.

The tokens of a prefix end with a token that fits the tokens before it; which one is
decided by whether the pair would survive encoding.  So one pass over the bytes of a
word gives the last token, and the count, of each of its prefixes.  They are returned as
the change that every byte makes, and the total, the limit's verdict and truncation to any
budget are read from that.

Where the library's tables of letters, digits and white space differ from those of the
pattern's engine, words come from the library's own splitter: each character outside
ASCII is tried once in both.

The tokens that may end at a byte come from an automaton of all tokens, made as its nodes
are met, so a byte costs a step and mostly one trial, however long tokens are.

Words recur, so a worker keeps the changes of words that it has met; when the cache reaches
a limit, the words not met since it last did are let go.

Defined results: a null or empty text has no tokens; repeated rows count alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contractions that the pattern takes as one word although it is three characters.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Words whose changes one worker keeps, once as the newer and once as the older ones.
CACHE_WORDS = 300_000
#: Pairs of tokens, and steps of a byte, that one worker keeps.
CACHE_PAIRS = 2_000_000
CACHE_STEPS = 1_000_000
#: Where a node has the tokens that end there; other keys are bytes.
_ENDS = 256


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the vocabulary file and the bytes they mean."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts tokens of all prefixes as the tokenizer in ``path`` would."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in data["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        special = set(self.special)
        self.rank: dict[bytes, int] = {}
        vocab = data["model"]["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        order = {}
        for token in vocab:
            if token not in special and len(token) == 1:
                order[to_bytes(token)] = len(order)
        for i, merge in enumerate(data["model"]["merges"]):
            left, right = (to_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = left + right
            if whole in order:
                raise ValueError("a token with two merges")
            order[whole] = 256 + i
            self.parts[256 + i] = (order[left], order[right])
            self.pairs[order[left], order[right]] = 256 + i
        if min(self.pairs.values()) < len(letters):
            raise ValueError("not a byte-level vocabulary")
        self.rank = order
        # What tokens begin with: the bytes seen last are a node as long as some token goes on like that.
        self.begun = {token[:k] for token in order for k in range(1, len(token) + 1)}
        self.nodes: dict[bytes, dict] = {}
        self.names: dict[int, bytes] = {}
        self.steps = 0
        self.root = self._node(b"")
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        # A text between two of which no prefix reaches over: white space and what follows it.
        self.runs = regex.compile(r"\s*\S+|\s+").findall
        self.odd_space = regex.compile(r"[ ](?=\s)|(?<=\s)[ ]|[ ]$").search
        self.blank = regex.compile(r"\s+").fullmatch
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.kinds = [("a", regex.compile(r"\p{L}").fullmatch), ("1", regex.compile(r"\p{N}").fullmatch), (".", regex.compile(r"[^\s\p{L}\p{N}]").fullmatch)]
        self.agreed: set[str] = set()
        self.odd: set[str] = set()

    def _split(self, chunk: str) -> list[str]:
        """The words of a chunk."""
        if not chunk.isascii() and not self.agreed.issuperset(chunk):
            for c in set(chunk) - self.agreed - self.odd:
                # A character goes on with one of its kind.
                alike = all((len(self.library.pre_tokenize_str(one + c)) == 1) == bool(kind(c)) for one, kind in self.kinds)
                (self.agreed if alike else self.odd).add(c)
            if self.odd and not self.odd.isdisjoint(chunk):
                return [chunk[a:b] for _, (a, b) in self.library.pre_tokenize_str(chunk)]
        return self.find(chunk)

    def _fit(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their bytes are encoded together.

        The merges inside both are undone from the latest to the earliest; they
        stay apart unless, before some merge happened, the two tokens that meet at
        the seam would have merged first.
        """
        before = 1 << 60
        parts, pairs = self.parts, self.pairs
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < before:
                return False
            # The later of the two merges next to the seam is undone.  Equal merges run
            # from the left, so the left token's counts as the earlier one.
            if a > b:
                if a < 256:
                    return True
                before, a = a, parts[a][1]
            else:
                if b < 256:
                    return True
                before, b = b + 1, parts[b][0]

    def _node(self, name: bytes) -> dict:
        """The node of the bytes ``name``, with length and number of all tokens that end there, longest first."""
        node = self.nodes.get(name)
        if node is None:
            ends = [(len(name) - i, self.rank[name[i:]]) for i in range(len(name)) if name[i:] in self.rank]
            node = self.nodes[name] = {_ENDS: tuple(ends)}
            self.names[id(node)] = name
        return node

    def _step(self, node: dict, byte: int) -> dict:
        """The node after one more byte: the longest end of what was seen that begins a token."""
        name = self.names[id(node)] + bytes([byte])
        while name not in self.begun:
            name = name[1:]
        if self.steps >= CACHE_STEPS:
            # Nodes stay, so that a word under way goes on.
            for known in self.nodes.values():
                ends = known[_ENDS]
                known.clear()
                known[_ENDS] = ends
            self.steps = 0
        self.steps += 1
        made = node[byte] = self._node(name)
        return made

    def word_prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ... for one word of the pattern."""
        fits, node = self.fits, self.root
        last: list[int] = [-1]
        count = [0]
        end = 0
        for byte in word:
            end += 1
            node = node.get(byte) or self._step(node, byte)
            for length, token in node[_ENDS]:
                start = end - length
                if start:
                    pair = last[start] << 20 | token
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) >= CACHE_PAIRS:
                            fits.clear()
                        good = fits[pair] = self._fit(last[start], token)
                    if not good:
                        continue
                last.append(token)
                count.append(count[start] + 1)
                break
        return count

    def _keep(self, piece: str, made: bytes) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.older, self.words = self.words, {}
        self.words[piece] = made
        return made

    def _known(self, piece: str) -> bytes | None:
        made = self.words.get(piece)
        if made is None and (made := self.older.get(piece)) is not None:
            self._keep(piece, made)
        return made

    def _word(self, word: str) -> bytes:
        counts = self.word_prefixes(word.encode("utf-8", "surrogatepass"))
        if word in LONG_CONTRACTIONS:
            counts[2] = 2
        return self._keep(word, _steps(counts))

    def _chunk(self, chunk: str) -> bytes:
        if (known := self._known(chunk)) is not None:
            return known
        found = self._split(chunk)
        made: list[bytes] = []
        i, shift = 0, 0
        while i < len(found):
            word = found[i]
            if word[-1].isspace() and self.blank(word):
                run = [*itertools.takewhile(self.blank, found[i:])]
                i += len(run)
                counts = self.word_prefixes("".join(run).encode())
                made.append(_steps(counts))
                # Before another word the run is split.
                shift = sum(self.word_prefixes(w.encode())[-1] for w in run) - counts[-1] if len(run) > 1 else 0
                continue
            known = self._known(word)
            known = self._word(word) if known is None else known
            made.append(_steps([0, known[0] + shift]) + known[1:] if shift else known)
            i, shift = i + 1, 0
        return made[0] if len(found) == 1 else self._keep(chunk, b"".join(made))

    def _chunks(self, text: str) -> list[str]:
        """Pieces of text between which no word of the pattern reaches, at any of its prefixes.

        A single space between other characters always begins a word; where spaces
        stand otherwise, white space goes with what follows it.
        """
        if self.odd_space(text):
            return self.runs(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if self.split_special and "<|" in text:
            for found in self.split_special.finditer(text):
                yield text[at : found.start()], False
                yield found.group(), True
                at = found.end()
        yield text[at:], False

    def changes(self, text: str | None) -> bytes:
        """The change of the count by each byte of the text, as signed bytes.

        A prefix may end where the pattern splits it differently than the whole
        text: inside white space before a word, and inside a contraction.
        """
        made: list[bytes] = []
        before = ""
        for part, special in self._segments(text or ""):
            if special:
                # Until it is complete, the special string is text like what stands before it.
                base = self.count(before)
                counts = [base, *[self.count(before + part[:i]) for i in range(1, len(part))], base + 1]
                made.append(np.diff(counts).astype(np.int8).tobytes())
                before = ""
            elif part:
                words, chunk = self.words, self._chunk
                own = self._chunks(part)
                made += [x if (x := words.get(c)) is not None else chunk(c) for c in own]
                before = part
        return b"".join(made)

    def count(self, text: str | None) -> int:
        return total(self.changes(text))

    def prefixes(self, text: str | None) -> list[int]:
        """Token counts of every prefix of the text's bytes, the empty one included."""
        return [0, *np.cumsum(np.frombuffer(self.changes(text), np.int8), dtype=np.int64).tolist()]


def _steps(counts: list[int]) -> bytes:
    """Differences of the counts as signed bytes."""
    made = list(map(operator.sub, counts[1:], counts))
    try:
        plain = bytes(made)
        if plain.isascii():
            return plain
    except ValueError:
        pass  # some are negative
    if not -128 <= min(made) <= max(made) <= 127:
        raise ValueError("a byte changes the count by too much")
    return bytes([x & 255 for x in made])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file; a worker makes it once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def total(changes: bytes) -> int:
    """Tokens of the whole text."""
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


def fitting_bytes(changes: bytes, body: bytes, budget: int) -> int:
    """Bytes of the longest prefix of whole characters that has at most ``budget`` tokens."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])
    ends = np.ones(len(counts), bool)  # where no character is cut
    ends[:-1] = np.frombuffer(body, np.uint8) & 0xC0 != 0x80
    return int(np.nonzero((counts <= budget) & ends)[0][-1])


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes, tokens, the limit's verdict and the counts of all prefixes for every whole text.

    ``prefix_changes`` has a signed byte for each byte of the text: what it adds to the
    tokens.  ``fit_bytes`` is the longest cut at a character's end within the limit.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            bytes_, tokens, fitting, made = [], [], [], []
            for text_ in batch.column("_body").to_pylist():
                body = text_.encode("utf-8", "surrogatepass")
                changes = counts.changes(text_)
                n = total(changes)
                bytes_.append(len(body))
                tokens.append(n)
                fitting.append(len(body) if n <= limit else fitting_bytes(changes, body, limit))
                made.append(changes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fitting, pa.int64()), pa.array(made, pa.binary())],
                names=["_key", "n_bytes", "n_tokens", "over_limit", "fit_bytes", "prefix_changes"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long, prefix_changes binary").withColumnRenamed("_key", key)
