"""Odd rows, brute-force versions and SQL on small tables of all operators."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, hot, langid, quality, queries, shards, suffix_dedup, url_filter
from tesserae.session import materialise


def written(spark, tmp_path, rows, schema="doc_id long, text string, lang string"):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}", f"{tmp_path}/documents.parquet/*.parquet"


def against_sql(spark, tmp_path, name, rows):
    sf_dir, files = written(spark, tmp_path, rows)
    got = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, expected))


PADDED = ["home." + " " * 250, "All rights reserved." + " " * 80, "  Log in  »", "home\r", "more ... more", "ho.me", "x" * 300 + " home", "menu | menu | a | b", "a  b   c " * 12, "next\x0b", "\x85next"]


def test_padded_lines_against_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.sample(PADDED, rng.randrange(1, 6)) + [" ".join(rng.choice("abcdefgh") for _ in range(60)) + "."]), "aa") for i in range(60)]
    rows += [(100 + i, line, "aa") for i, line in enumerate(PADDED)] + [(None, None, None), (200, "", None)]
    against_sql(spark, tmp_path, "op8_line_rules", rows)


def test_padding_does_not_save_a_line(spark):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(PADDED)], "doc_id long, text string")
    failed = {r["doc_id"] for r in quality.judge(rows).collect() if r["n_failed_lines"]}
    assert failed == {0, 1, 2, 3, 7, 8, 9}


def test_shards_against_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab é日") for _ in range(rng.randrange(20))), "aa") for i in range(400)]
    against_sql(spark, tmp_path, "op3_rendezvous_shards", rows + [(7, "other", None), (7, "other", None), (None, None, None), (-3, "", None)])


def test_shards_against_plain_python(spark):
    weights, keys = [1.0, 2.5, 0.5], [*range(300), None]
    docs = spark.createDataFrame([(k, "x" * (k or 0)) for k in keys], "key long, text string")
    extra = {"size": F.octet_length("text"), "crc": F.crc32(F.encode("text", "UTF-8"))}
    got = {r["key"]: r for r in shards.assign(docs, "key", weights, extra, seed=4).collect()}

    def cost(i, w, key):
        n = int(hashlib.md5(f"4:{i}:{'' if key is None else key}".encode()).hexdigest()[:13], 16)
        return -math.log((n + 0.5) / 2**52) / w

    for key in keys:
        costs = [cost(i, w, key) for i, w in enumerate([*weights, sum(weights) / 3])]
        assert got[key]["shard"] == min(range(3), key=costs.__getitem__)
        assert got[key]["grown_shard"] == min(range(4), key=costs.__getitem__)
        text = "x" * (key or 0)
        assert (got[key]["size"], got[key]["crc"]) == (len(text), zlib.crc32(text.encode()))


def test_a_host_with_very_many_labels(spark):
    labels = spark.range(240_000).select(F.concat(F.lit("http://h.org/"), F.when(F.col("id") % 3 == 0, "bad").otherwise("good"), F.lit("/"), F.col("id")).alias("url"), (F.col("id") % 3 == 0).cast("int").alias("bad"))
    many = labels.crossJoin(spark.range(20)).select("url", "bad")
    pages = spark.createDataFrame([(1, "http://h.org/bad/1"), (2, "http://h.org/good/1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, many, []).collect()} == {1: "block", 2: "allow"}


def test_merged_branches_are_looked_at_together(spark):
    # Many users, each with few labels: their posts are bad, their photos are not.
    seen = [(f"http://h.org/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/{kind}", int(kind == "posts")) for i in range(90) for kind in ("posts", "photos", "photos")]
    # Alike branches are merged: below them /old is bad in all.
    seen += [(f"http://g.org/{lang}/{kind}", int(kind == "old")) for lang in ("de", "fr", "es") for kind in ("old", "new", "new") for _ in range(12)]
    pages = [(1, "http://h.org/u/zed/posts"), (2, "http://h.org/u/zed/photos"), (3, "http://g.org/it/old"), (4, "http://g.org/fr/new"), (5, "http://h.org/" + "a/" * 40)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(seen, "url string, bad int"), []).collect()}
    assert {i: r["verdict"] for i, r in rows.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    assert rows[1]["branch"] == "/*/*/posts" and rows[3]["branch"] == "/*/old"
    assert rows[5]["template"].count("/") == 40


def test_urls_are_told_apart_at_any_depth(spark):
    # One host holds most templates, so its rows are dealt; what tells stands in the seventh segment.
    deep = "http://h.org/" + "a/" * 6
    seen = [(f"{deep}{kind}/{i}", int(kind == "x")) for i in range(30) for kind in ("x", "y")]
    pages = [(1, f"{deep}x/77/b"), (2, f"{deep}y/77/b"), (3, f"{deep}z"), (4, "http://cold.org/" + "a/" * 6 + "x/1")]
    pages += [(10 + i, f"{deep}y/{chr(97 + i % 26)}/{chr(97 + i // 26)}") for i in range(300)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(seen, "url string, bad int"), []).collect()}
    assert len(rows) == 304 and rows[1]["branch"].endswith("/x/*") and rows[2]["branch"].endswith("/y/*")
    assert (rows[1]["verdict"], rows[2]["verdict"]) == ("block", "allow")
    assert {rows[i]["verdict"] for i in range(10, 310)} == {"allow"} and rows[4]["branch"] == ""


def test_two_labels_for_one_url(spark):
    pages = spark.createDataFrame([(1, "http://h.org/p"), (2, "http://h.org/p")], "page_id long, url string")
    labels = spark.createDataFrame([("http://h.org/p", b) for b in [1] * 40 + [0] * 5], "url string, bad int")
    rows = url_filter.judge(pages, labels, []).collect()
    assert len(rows) == 2 and {(r["verdict"], r["bad_share"]) for r in rows} == {("block", round((40 + 20 * (40 + 20 * 40 / 45) / 65) / 65, 6))}


def test_hot_keys_are_dealt(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    right = materialise(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 'k2999'"), "right")
    got = {r["id"]: r["n"] for r in hot.join_unique(left, right, ["k"], "n", ["id"], one_in=10).collect()}
    assert len(got) == 3000 and got[0] == got[1999] == 2000 and got[2500] == 1 and got[2999] is None
    assert hot.join_unique(left, right, ["k"], "n", ["id"], how="inner").count() == 2999
    assert hot.keep_known(left, right, ["k"], "n", one_in=10).count() == 2999
    assert hot.join_unique(left.limit(0), right.limit(0), ["k"], "n", ["id"]).count() == 0


def test_groups_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select((F.col("id") % 97).alias("doc_id"), F.concat(F.lit("same beginning of more than 32 characters "), F.col("id") % 5).alias("text"))
        got = exact_dedup.exact_groups(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 500 and {r["group_size"] for r in got} == {100}
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def spark_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_language_against_plain_python(spark):
    rng = random.Random(6)
    words = {"aa": ["tola", "miru", "kesa"], "bb": ["strong", "thrift", "blend"], "cc": ["日本", "語の", "文章"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 700))), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, rows[0][1], "aa"), (501, None, "aa"), (502, "x", None), (503, "", "bb"), (None, "tola " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for name in words:
        texts = {t for _, t, k in rows if k == name and t is not None}
        parts = []
        for h, t in sorted((spark_hash(t), t) for t in texts):
            start = h % (max(len(t) - langid.EXCERPT_CHARS, 0) + 1)
            parts.append(t[start : start + langid.EXCERPT_CHARS].lower())
        out = b""
        for p in parts[: langid.SAMPLE_TEXTS]:
            if len(out) + len(p.encode()) >= langid.DICTIONARY_BYTES:
                break
            out += p.encode() + b"\n"
        assert model[name] == out
    coders = {}
    for name, data in model.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders[name] = zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {(r["doc_id"], r["n"]): r for r in langid.classify(docs, model, keep={"doc_id": F.col("doc_id"), "n": F.char_length("text")}).collect()}
    for i, t, _ in rows:
        r = got[i, None if t is None else len(t)]
        if not t:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        body = t.lower().encode()
        sizes = {k: sum(len(c.compress(body[p : p + langid.BLOCK_BYTES])) for p in range(0, len(body), langid.BLOCK_BYTES)) for k, c in coders.items()}
        best = min(sorted(sizes), key=sizes.get)
        others = sorted(s for k, s in sizes.items() if k != best)
        assert r["lang_pred"] == best
        assert r["margin"] == pytest.approx((others[0] - sizes[best]) / others[0])
        assert r["rejected"] == (r["margin"] < langid.MIN_MARGIN)


def test_excerpts_are_whole():
    part = "日" * 1000
    made = langid.dictionary([part] * 400)
    assert len(made) <= langid.DICTIONARY_BYTES and made.decode() == (part + "\n") * (len(made) // 3001)


def test_held_out_accuracy(spark):
    """On the given table the languages of held-out documents are found."""
    rows = queries.op6_compression_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_null_id_is_not_held_out(spark, tmp_path):
    sf_dir, _ = written(spark, tmp_path, [(None, "tola", "aa"), (1, "tola", "aa"), (2, "blend", "bb")])
    assert {r["doc_id"]: r["held_out"] for r in queries.op6_compression_language(spark, sf_dir).collect()}[None] is False


def test_suffix_dedup_of_odd_rows(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(None, long), (1, long[:600]), (2, "x" + long[100:700]), (3, "y" * 200_000), (4, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None]["n_removed"] == 0 and got[4]["n_bytes"] == 0
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (500, 500, 200_000)
