"""The operators with Python inside, against brute-force versions on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import langid, merge_dropout, ngram_join, packing, suffix_dedup, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "a", "long " * 40000, "é日本\n\t ", "<|endoftext|> b<|endoftext|>", "x▁y  z ", "it's 're 12 \n\n\nend"]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, 0, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, id string")
    return df if extra else df.select("doc_id", "text")


def test_counts_match_the_library(spark):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(spark, ODD), BYTE_BPE, limit=3).collect()}
    for i, t in enumerate(ODD):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 3)
        cut = (t or "").encode()[: rows[i]["fit_bytes"]].decode()
        assert len(tokenizer.encode(cut, add_special_tokens=False).ids) <= 3
    assert token_counts.token_counts(docs_of(spark, ODD).limit(0), BYTE_BPE).count() == 0


def test_every_prefix():
    tokenizer, counter = Tokenizer.from_file(BYTE_BPE), token_counts.counter(BYTE_BPE)
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", " ", "\n", "'", "re", "s", "é", "<|endoftext|>", "1", ".", "日"]) for _ in range(rng.randrange(10)))
        made = counter.prefixes(text)
        for i in range(len(text) + 1):
            assert made[len(text[:i].encode())] == len(tokenizer.encode(text[:i], add_special_tokens=False).ids), (text, i)


def test_merge_dropout(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain, some = merge_dropout.MergeDropout(PIECES, 0.0), merge_dropout.MergeDropout(PIECES, 0.3, seed=3)
    rng = random.Random(1)
    for k in range(500):
        text = "".join(rng.choice(["the ", "ing", " ", "  ", "é", "\n", "日", "\U0001f600", "hello"]) for _ in range(rng.randrange(9)))
        assert plain.encode(text, "k").tolist() == model.encode(text)
        assert some.decode(some.encode(text, str(k))) == text
    forms = {tuple(some.encode("internationalization", str(k)).tolist()) for k in range(40)}
    assert len(forms) > 1
    rows = merge_dropout.decode(merge_dropout.encode(docs_of(spark, ODD), PIECES, rate=0.3, seed=3), PIECES).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == {i: t or "" for i, t in enumerate(ODD)}
    assert merge_dropout.encode(docs_of(spark, ODD).limit(0), PIECES).count() == 0


def test_languages(spark):
    rng = random.Random(4)
    words = {"aa": ["tola", "miru", "kesa", "vono", "lapi"], "bb": ["strong", "thrift", "glimpse", "crunch", "blend"]}
    texts = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows = [(i, t, k if i < 80 else None, "x") for i, t, k in texts] + [(900 + i, t, None, "x") for i, t in enumerate(ODD)] + [(950, "12 !", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    assert sorted(model) == ["aa", "bb"]
    got = {r["doc_id"]: r for r in langid.classify(docs, model, keep={"doc_id": docs["doc_id"]}).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, _, k in texts)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 950)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.classify(docs, {}, keep={"doc_id": docs["doc_id"]}).collect()} == {"und"}
    assert langid.classify(docs.limit(0), model).count() == 0


def check_packing(rows, sizes, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    pieces = collections.Counter()
    for r in rows:
        pieces[r["doc_id"]] += r["length"]
    assert pieces == collections.Counter(sizes)
    return len(bins)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["word", "Émile", "cat's", "x1", "..."]) for _ in range(rng.randrange(60))) for _ in range(300)]
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = packing.pack_documents(docs_of(spark, texts), WORD_BPE, capacity=64, group_pieces=100).collect()
    used = check_packing(rows, {i: len(x) for i, x in enumerate(ids)}, 64)
    assert used <= 1.03 * sum(map(len, ids)) / 64 + 2
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r["piece"] == r["start"] // 64
    assert packing.pack_documents(docs_of(spark, texts).limit(0), WORD_BPE).count() == 0


def test_local_search_beats_best_fit():
    rng = random.Random(6)
    sizes = [rng.randrange(600, 1100) for _ in range(3000)]
    first = packing.best_fit(sizes, 2048)
    then = packing.local_search(sizes, [list(b) for b in first], 2048)
    assert sorted(i for b in then for i in b) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in b) for b in then) <= 2048
    assert len(then) < len(first)


def brute_groups(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("bucket", [2, 64])
def test_ngram_join(spark, bucket, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 7)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    texts = ODD[:5] + ["A b", "a B", "a b c d", "a b c d e"]
    for k in range(90):
        words = list(base[k % 6])
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(words[: rng.randrange(52, 61)]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(spark, texts), n=4, percent=85, bucket=bucket).collect()}
    assert got == brute_groups(texts, 4, 85)


def brute_cut(texts, length):
    seen = collections.Counter()
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(bodies):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("split", [3, 4096])
def test_suffix_dedup(spark, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT_SEGMENTS", split)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh é") for _ in range(300))
    texts = [None, "", "short", "ab" * 50, "z" * 90]
    for _ in range(120):
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(60)))
        if rng.random() < 0.6:
            a = rng.randrange(280)
            t += base[a : a + rng.randrange(10, 80)]
        texts.append(t)
    texts += texts[5:8]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs_of(spark, texts), length=24, gram=6).collect()}
    assert got == brute_cut(texts, 24)


def test_suffix_dedup_of_one_id_on_several_texts(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcd é") for _ in range(300))
    texts = ["".join(rng.choice("abcd é") for _ in range(60)) + base[a : a + n] for a, n in ((0, 90), (30, 100), (200, 40), (120, 100), (0, 20), (180, 100))]
    texts += texts[:2]
    ids = [1, 1, 1, 2, 3, 3, 1, 2]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), length=24, gram=6).collect()
    expected = brute_cut(texts, 24)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == order((ids[i], *expected[i]) for i in range(len(ids)))
    assert all(r["n_removed"] <= r["n_bytes"] for r in rows)


def test_windows_are_compared_by_bytes():
    bodies = [b"abcdefgh", b"xbcdefgx", b"qqqqqqqq"]
    same = np.zeros(5, np.uint64)  # every window has one hash
    right = suffix_dedup.again([(1, np.array([1, 2, 3, 4, 5], "u8"), bodies[0]), (1, np.array([6, 2, 3, 4, 7], "u8"), bodies[1])], 4)
    assert [x.tolist() for x in right] == [[False, True, True, True, False]] * 2
    made = suffix_dedup.again([(1, same, bodies[0]), (1, same, bodies[1]), (1, same, bodies[2])], 4)
    assert [x.tolist() for x in made] == [[False, True, True, True, False], [False, True, True, True, False], [True] * 5]


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_long_texts_are_walked_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data, 40, 10), strict=True)]
    monkeypatch.setattr(suffix_dedup.bytehash, "BLOCK", 700)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data, 40, 10), strict=True)]
    owner = lambda a, lo, hi: np.repeat(a, hi - lo + 1)
    assert (owner(*whole) == owner(*parts)).all()
