"""What the prefix counts of a word cost, and that small caches change no count."""

import random
import sys

import public_tokenizers
from tokenizers import Tokenizer

from tesserae.llm import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_a_byte_costs_a_few_calls():
    counter = token_counts.PrefixCounter(BYTE_BPE)
    for word in ["日本語の文章" * 30, "aGVsbG8gd29ybGQ" * 20, " internationalisation" * 5]:
        body = word.encode()
        counter.word_prefixes(body)  # what is learned once
        calls = 0

        def count(frame, event, arg):
            nonlocal calls
            calls += event == "c_call"

        sys.setprofile(count)
        try:
            counter.word_prefixes(body)
        finally:
            sys.setprofile(None)
        assert calls < 7 * len(body), (word, calls / len(body))


def test_small_caches_change_nothing(monkeypatch):
    for name, size in {"CACHE_WORDS": 3, "CACHE_PAIRS": 5, "CACHE_STEPS": 7}.items():
        monkeypatch.setattr(token_counts, name, size)
    tokenizer, counter = Tokenizer.from_file(BYTE_BPE), token_counts.PrefixCounter(BYTE_BPE)
    rng = random.Random(23)
    parts = ["the", " word", "ing", " un", "é", "日本", "\n", "  ", "'ll", "1", ".", "aGVs", "\t", "<|endoftext|>"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        counts = counter.prefixes(text)
        for k in range(len(text) + 1):
            assert counts[len(text[:k].encode())] == len(tokenizer.encode(text[:k], add_special_tokens=False).ids), (text, k)
    assert len(counter.words) <= 3 and len(counter.older) <= 3
