"""The returned prefix counts against the library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tesserae.llm import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_prefix_counts_are_returned(spark):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(3)
    parts = ["a", "the", " ", "\n", "\t", "'", "re", "ll", "é", "<|endoftext|>", "1", ".", "日本", "\x1c", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(150)]
    texts += [None, "", "日本語の文章" * 30, "aGVsbG8" * 40, "foo\n bar", "a \n b  c "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs, BYTE_BPE, limit=5).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        counts = [0, *np.cumsum(np.frombuffer(rows[i]["prefix_changes"], np.int8)).tolist()]
        assert len(counts) == len(text.encode()) + 1
        assert counts[-1] == rows[i]["n_tokens"]
        within = 0
        for k in range(len(text) + 1):
            at, n = len(text[:k].encode()), len(tokenizer.encode(text[:k], add_special_tokens=False).ids)
            assert counts[at] == n, (text, k)
            within = at if n <= 5 else within
        assert rows[i]["fit_bytes"] == within
        assert token_counts.fitting_bytes(rows[i]["prefix_changes"], text.encode(), 10**9) == len(text.encode())


def test_letters_of_the_library():
    """Characters that only one of the two Unicode tables knows, and all kinds of others."""
    tokenizer, counter = Tokenizer.from_file(BYTE_BPE), token_counts.counter(BYTE_BPE)
    assert tokenizer.encode_special_tokens is False
    rng = random.Random(11)
    odd = [chr(c) for c in (0x209E, 0x208F, 0x11DBB, 0x1C89, 0xA7CB, 0x10D40, 0x16EA0, 0x378, 0x1FBF0, 0x85, 0x180E, 0x200B, 0x2028, 0xFEFF, 0x3000, 0x0E33, 0x1F600)]
    every = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}'re" for c in odd]
    for _ in range(6000):
        parts = [rng.choice(odd) if rng.random() < 0.4 else chr(rng.choice(every)), rng.choice(["'re", "'ve", "'s", "a", "1", ".", " ", "\n", "  "])]
        texts.append("".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))))
    for text in texts:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), ascii(text)
