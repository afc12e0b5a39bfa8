"""Boundary sets and fill-in-the-middle: rank and select, SQL, round trips, odd rows."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import fill_middle, queries
from tesserae.llm.boundaries import BoundarySet

SETS = {
    "array": np.arange(0, 60_000, 60),
    "bitmap": np.array(sorted(random.Random(1).sample(range(65_536), 20_000))),
    "run": np.arange(100, 50_000),
    "mixed": np.concatenate([np.arange(0, 60_000, 61), 65_536 + np.arange(0, 65_536, 3), 200_000 + np.arange(70_000)]),
    "one": np.array([65_535]),
    "none": np.array([], np.int64),
}


@pytest.mark.parametrize("name", SETS)
def test_select_and_rank(name):
    members = SETS[name]
    made = BoundarySet(members)
    assert len(made) == len(members)
    if name in ("array", "bitmap", "run"):
        assert [c.kind for c in made.containers] == [name]
    for k in {0, 1, 63, 64, 65, len(members) // 2, len(members) - 1} & set(range(len(members))):
        assert made.select(k) == members[k]
    for x in (0, 63, 64, 65_535, 65_536, 131_071, 140_000, 200_500, 10**7, *members[:: max(len(members) // 50, 1)].tolist()):
        assert made.rank(x) == np.searchsorted(members, x, "right")
    with pytest.raises(IndexError):
        made.select(len(members))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=300))
def test_every_member_is_selected(members):
    made = BoundarySet(np.array(sorted(members), np.int64))
    assert [made.select(k) for k in range(len(made))] == sorted(members)


def texts():
    rng = random.Random(4)
    parts = ["a", "bé", "日本", "<", "<P", "S>", "<M>", " ", "  ", "\n", "\t", "\x0b", "\x85", "　", "x" * 30]
    rows = [(i, "".join(rng.choice(parts[: 15 if i % 5 == 0 else 5] + parts[7:]) for _ in range(rng.randrange(40)))) for i in range(400)]
    long = "".join(rng.choice(["word ", "é\n", "longer  ", "a "]) for _ in range(400_000))
    return rows + [(1000, None), (1001, ""), (1002, " "), (1003, "<S>"), (1004, long), (None, "no id here at all"), (-7, "minus seven of them"), (5, "five again"), (5, "five again")]


def test_against_sql(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "c") for r in texts()], "doc_id long, text string, id int, output string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_fill_middle"](spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op13_fill_middle']})").fetchall()
    rows = got.collect()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, expected))
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("unit", ["word", "character"])
def test_round_trip(spark, unit):
    plan = fill_middle.Plan(seed=9, rearranged_percent=90, suffix_first_percent=50, unit=unit)
    docs = spark.createDataFrame([r for r in texts() if r[0] != 5], "doc_id long, text string")
    made = fill_middle.rearrange(docs, plan=plan)
    rows = made.withColumn("back", fill_middle.restore(made["output"], made["form"], plan)).collect()
    given_ = {r[0]: r[1] or "" for r in texts()}
    assert {r["id"]: r["back"] for r in rows} == {k: v for k, v in given_.items() if k != 5}
    assert sum(r["form"] != "plain" for r in rows) > 200
    for r in rows:
        if r["form"] == "psm":
            assert r["output"].startswith("<P>" + given_[r["id"]][: r["prefix_chars"]] + "<S>")


def test_empty_table_and_names(spark):
    assert fill_middle.rearrange(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    odd = spark.createDataFrame([("k", "a b c")], "`the.key` string, `the.text` string")
    assert fill_middle.rearrange(odd, "the.key", "the.text").first()["id"] == "k"
    with pytest.raises(ValueError):
        fill_middle.rearrange(odd, "the.key", "the.text", fill_middle.Plan(unit="page"))
