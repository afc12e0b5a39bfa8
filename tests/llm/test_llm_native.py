"""The operators made of DataFrame functions, against plain Python."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, quality, shards, url_filter


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "a b c"), (None, "x y"), (5, "word " * 30000), (6, "a b c a b c a b c\nHome\n\nHome\n"), (7, "\n \t")]
    return spark.createDataFrame([(i, t, 0, 0, "k") for i, t in rows], "doc_id long, text string, shard int, n_words int, key string")


def test_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    rows = shards.assign(docs, "doc_id", [1.0] * 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert all(400 < len(slots) < 600 for slots in by.values())
    assert 300 < sum(r["grown_shard"] == 8 for r in rows) < 600
    grown = {r["doc_id"]: r["shard"] for r in shards.assign(docs, "doc_id", [1.0] * 9).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_weights(spark):
    rows = shards.assign(spark.range(6000).select(F.col("id").alias("k")), "k", [1.0, 3.0]).groupBy("shard").count().collect()
    assert 0.2 < {r["shard"]: r["count"] for r in rows}[0] / 6000 < 0.3


def test_shards_of_odd_rows(spark, odd):
    rows = shards.assign(odd, "doc_id", [1.0] * 3, {"size": F.octet_length(F.coalesce("text", F.lit(""))) + 1}).collect()
    assert len(rows) == 9
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shards.assign(odd.limit(0), "doc_id", [1.0]).count() == 0


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(words) < 3000 else set(range(len(words)))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, odd):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "b", " ", "\n", "é", "#", " the ", " cat ", "\t"]) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(200 + i, r["text"]) for i, r in enumerate(odd.collect())]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.judge(docs_of(spark, rows)).collect()}
    assert got == {i: brute_quality(t) for i, t in rows}
    assert quality.judge(odd.limit(0)).count() == 0
    assert quality.judge(odd).count() == 9


def test_line_rules(spark):
    rng = random.Random(2)
    prose = "\n".join(" ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(99)) for _ in range(12)) + "." for _ in range(9))
    menu = "Home | About | Contact | Login\nPrivacy policy and cookie policy\nnext\n"
    rows = [(1, prose), (2, menu + prose), (3, "\n".join(["Home | News | Sport | Weather | More | All rights reserved"] * 3 + [f"Menu {i} | item {i} | thing {i} | part {i}" for i in range(20)]) + "\nOne good line here.")]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, rows)).collect()}
    assert got[1]["kept"] and got[1]["cleaned_text"] == prose
    assert got[2]["kept"] and got[2]["cleaned_text"] == prose
    assert not got[3]["kept"]


RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"(?s)[^?#]*", rest[len(host) :])[0]


def test_url_parts_and_rules(spark):
    urls = [None, "", "x", "http://A.Example.COM/en/1?q#f", "https://www.example.com/en/2#a", "ftp://b.net/es/x", "http://net/es/", "a://b://c/d", "http://example.com", "http://ÄB.com/ü?x", "http://notexample.com/en/", "http://h\n.com/a\nb?c"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "url string, bad int"), RULES).collect()}
    assert {i: (r["host"], r["path"]) for i, r in rows.items()} == {i: brute_url(u) for i, u in enumerate(urls)}
    assert [rows[i]["rule"] for i in range(12)] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", "net/es/", None, None, "com/", "com/", "com/"]
    assert {r["verdict"] for r in rows.values()} == {"allow", "block"}
    assert url_filter.judge(pages.limit(0), pages.limit(0).select("url", F.lit(1).alias("bad")), RULES).count() == 0


def test_bad_templates_are_rejected(spark):
    seen = [(f"http://h.org/spam/{i}.html", 1) for i in range(60)] + [(f"http://h.org/news/{i}.html", 0) for i in range(60)] + [(f"http://h.org/blog/{i}", 0) for i in range(3)]
    labels = spark.createDataFrame(seen, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://h.org/spam/999.html"), (2, "http://h.org/news/999.html"), (3, "http://h.org/blog/7"), (4, "http://other.org/x")], "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, labels, []).collect()}
    assert rows[1]["verdict"] == "block" and rows[1]["bad_share"] > 0.8
    assert [rows[i]["verdict"] for i in (2, 3, 4)] == ["allow"] * 3
    assert rows[2]["template"] == "/news/{n}.html"


def test_exact_groups(spark, odd):
    rows = {(r["doc_id"], r["text_sha256"][:4]): r for r in exact_dedup.exact_groups(odd).collect()}
    assert len(rows) == 8  # the repeated row shows twice, alike
    by = {r["doc_id"]: r for r in rows.values()}
    assert (by[3]["keep_id"], by[3]["group_size"], by[3]["kept"], by[4]["kept"]) == (4, 3, False, True)
    assert (by[1]["keep_id"], by[2]["keep_id"], by[2]["group_size"]) == (2, 2, 2)
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(odd, keep="min").collect()}
    assert least[4] == 3
    spaced = exact_dedup.exact_groups(docs_of(spark, [(1, "A  b"), (2, "a b ")]), normalise="lower_space").collect()
    assert {r["keep_id"] for r in spaced} == {2}


def test_crc(spark):
    row = spark.createDataFrame([("ä",)], "t string").select(F.crc32(F.encode("t", "UTF-8"))).first()
    assert row[0] == zlib.crc32("ä".encode())
