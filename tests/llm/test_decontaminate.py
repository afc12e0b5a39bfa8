"""Suffix automaton against plain search, SQL, several automata, removal, odd rows."""

import random

import duckdb
import pytest

from tesserae.llm import decontaminate, queries
from tesserae.llm.decontaminate import Automaton, Matcher


def plain(items, words, window):
    """Hit words and items by trying every window at every place."""
    hit, found = set(), set()
    for item, text in items:
        size = min(window, len(text))
        for a in range(len(text) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == text[a : a + size]:
                    hit.update(range(i, i + size))
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_automaton_against_plain_search(window):
    rng = random.Random(window)
    draw = lambda n, letters: [rng.choice(letters).encode() for _ in range(n)]
    for round_ in range(60):
        letters = "abc" if round_ % 2 else "abcdefgh"
        items = [(str(i), draw(rng.randrange(0, 16), letters)) for i in range(rng.randrange(1, 6))]
        made = Automaton(window)
        for item, words in items:
            if words:
                made.add(item, words)
        matcher = Matcher(made.packed())
        for _ in range(4):
            words = draw(rng.randrange(60), letters + "z")
            if rng.random() < 0.7:
                at, part = rng.randrange(len(words) + 1), rng.choice(items)[1]
                words[at:at] = part
            spans, found = matcher.match(words)
            hit, expected = plain(items, words, window)
            assert {i for a, b in spans for i in range(a, b)} == hit
            assert {matcher.ids[i] for i in found} == expected
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def tables():
    rng = random.Random(5)
    words = ["der", "Die", "das", "x1", "Ünd", "日本", "b", "to", "été"]
    phrase = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(phrase(rng.randrange(10, 40)))) for i in range(30)]
    items += [(40, "Only three words"), (41, "only, THREE words!"), (42, ""), (43, None), (44, "..."), (45, "shared " + items[3][1]), (46, "solo"), (10, items[4][1]), (None, "an item without any id of its own at all here")]
    docs = []
    for i in range(150):
        text = phrase(rng.randrange(0, 60))
        if i % 2:
            part = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(part) + 1)
            text[5:5] = part[a : a + rng.randrange(5, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(text)))
    docs += [(500, None), (501, ""), (502, "?!"), (503, "only three words"), (504, "SOLO"), (None, items[2][1]), (7, items[5][1]), (7, items[5][1])]
    docs += [(600, "filler " * 2_000 + items[6][1] + " filler" * 100)]
    return docs, items


def test_against_sql(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, spans int, item string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op11_suffix_automaton"](spark, f"file://{tmp_path}")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op11_suffix_automaton']})").fetchall()
    rows = got.collect()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, expected))
    assert sum(r["contaminated"] for r in rows) > 30


def test_many_small_automata_find_the_same(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs[:-1], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.automata(b)
    several = decontaminate.automata(b, block_words=120)
    assert one.count() == 1 and several.count() > 4
    row = lambda r: (r["id"], r["n_words"], r["spans"], r["items"])
    order = lambda rows: sorted(map(row, rows), key=repr)
    assert order(decontaminate.find(d, one).collect()) == order(decontaminate.find(d, several).collect())


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(300)]
    blocks = decontaminate.automata(spark.createDataFrame([(1, " ".join(words))], "item_id int, text string"), block_words=30)
    docs = spark.createDataFrame([(i, " ".join(["x", *words[i : i + 10], "y"])) for i in range(0, 291)], "doc_id int, text string").coalesce(2)
    assert {(r["spans"][0]["start"], r["spans"][0]["stop"], len(r["spans"])) for r in decontaminate.find(docs, blocks).collect()} == {(1, 11, 1)}


def test_very_long_text(spark):
    _, items = tables()
    blocks = decontaminate.automata(spark.createDataFrame(items, "item_id long, text string"))
    docs = spark.createDataFrame([(1, "filler to das " * 300_000 + items[6][1] + " filler" * 100)], "doc_id int, text string")
    row = decontaminate.remove(docs, blocks).first()
    n = len(items[6][1].split())
    assert any(s["start"] <= 900_000 and s["stop"] >= 900_000 + n for s in row["spans"]) and row["n_words"] == 900_100 + n
    assert items[6][1] not in row["cleaned_text"]


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([("q", passage), ("s", "tiny item")], "item_id string, text string")
    docs = [("a", f"Before, {passage.upper()}! After some words that are not hit and go on for long enough to keep it, tiny item."), ("b", passage + " tail"), ("c", "clean"), ("d", None)]
    rows = {r["id"]: r for r in decontaminate.remove(spark.createDataFrame(docs, "doc_id string, text string"), decontaminate.automata(items)).collect()}
    assert rows["a"]["cleaned_text"] == "Before, ! After some words that are not hit and go on for long enough to keep it, tiny item."
    assert (rows["a"]["items"], rows["a"]["dropped"]) == (["q", "s"], False)
    assert (rows["b"]["cleaned_text"], rows["b"]["dropped"]) == ("", True)
    assert (rows["c"]["cleaned_text"], rows["d"]["cleaned_text"], rows["d"]["n_words"]) == ("clean", "", 0)


def test_no_items_and_no_documents(spark):
    none = decontaminate.automata(spark.createDataFrame([(1, None), (2, "--")], "item_id int, text string"))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    row = decontaminate.find(docs, none).first()
    assert (row["n_words"], row["spans"], row["items"]) == (3, [], [])
    some = decontaminate.automata(spark.createDataFrame([(1, "a b")], "item_id int, text string"))
    assert decontaminate.find(docs.limit(0), some).collect() == []
    with pytest.raises(ValueError):
        decontaminate.automata(docs.withColumnRenamed("doc_id", "item_id"), block_words=5)
