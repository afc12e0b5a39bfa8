"""Merge dropout against a plain version that looks at every pair in each turn."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from tesserae.llm import merge_dropout

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = "internationalization"
ALL = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


class Plain:
    """The same hash and rules, one pair at a time."""

    def __init__(self, rate, seed):
        model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.least, self.seed = round(rate * (1 << 64)), seed

    def encode(self, text, key):
        record = xxhash.xxh64_intdigest(key, self.seed)
        out, place = [], 0
        parts = (" " + text).split("▁") if text else []
        for k, part in enumerate(parts):
            for word in [["▁"] if k else [], re.findall(" *[^ ]+| +", part)]:
                for w in word:
                    place += 1
                    out += self.bytes_of("▁") if w == "▁" else self.word(w.replace(" ", "▁"), mixed((record + place * 0x9E3779B97F4A7C15) & ALL))
        return out

    def bytes_of(self, part):
        return [self.bytes[b] for b in part.encode()]

    def word(self, word, key):
        parts, skipped, turn = list(word), set(), 0
        while True:
            pairs = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score and (sum(map(len, parts[:i])), a, b) not in skipped]
            if not pairs:
                return [x for p in parts for x in ([self.ids[p]] if p in self.ids else self.bytes_of(p))]
            _, i = min(pairs)
            turn += 1
            if mixed((key + turn * 0x9E3779B97F4A7C15) & ALL) < self.least:
                skipped.add((sum(map(len, parts[:i])), parts[i], parts[i + 1]))
            else:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the ", "ing", " ", "  ", "é", "\n", "日本", "\U0001f600", "hello", "▁", "nation", "walk", "x", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)] + ["", " ", "▁", "a▁▁ b ", WORD * 5, "ab" * 70]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_against_the_plain_version(rate, monkeypatch):
    plain, fast = Plain(rate, 7), merge_dropout.MergeDropout(PIECES, rate, seed=7)
    texts = random_texts(300, 2)
    keys = [str(k) for k in range(len(texts))]
    expected = [plain.encode(t, k) for t, k in zip(texts, keys, strict=True)]
    for long_word, block in ((64, 1 << 20), (3, 1 << 20), (64, 1), (64, 9), (5, 40)):
        monkeypatch.setattr(merge_dropout, "LONG_WORD", long_word)
        monkeypatch.setattr(merge_dropout, "BLOCK_CHARS", block)
        flat, sizes = fast.encode_all(texts, keys)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == expected, (long_word, block)
        assert fast.decode_all(flat, sizes).to_pylist() == texts
    if not rate:
        model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        assert [model.encode(t) for t in texts if "▁" not in t and "\x00" not in t] == [e for e, t in zip(expected, texts, strict=True) if "▁" not in t and "\x00" not in t]


def test_forms_of_a_word_are_not_bounded():
    some = merge_dropout.MergeDropout(PIECES, 0.3, seed=3)
    assert len({tuple(some.encode(WORD, str(k)).tolist()) for k in range(400)}) > 40
    whole = " ".join([WORD] * 400)
    assert some.decode(some.encode(whole, "one record")) == whole
    assert len({tuple(some.encode(f"{WORD} {WORD} {WORD}", str(k)).tolist()) for k in range(400)}) > 300


def test_skips_come_at_the_rate():
    some = merge_dropout.MergeDropout(PIECES, 0.1, seed=1)
    keys = merge_dropout._mixed(np.arange(4000, dtype="u8"))
    for turn in range(64):
        assert some.skips(keys, turn).mean() == pytest.approx(0.1, abs=0.03)


def test_one_long_word_takes_time_in_proportion():
    some = merge_dropout.MergeDropout(PIECES, 0.1, seed=1)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000))
    assert some.decode(some.encode(text, "k")) == text
