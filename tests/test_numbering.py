"""Numbering without one task, and features away from all edges."""

from tesserae.functions.stats import number_rows
from tesserae.operators import autocorr


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 1009 AS id", "id AS value").repartition(7)
    got = sorted((r["id"], r["n"]) for r in number_rows(rows, "id", "n").collect())
    assert [n for _, n in got] == list(range(1, 1001))
    assert number_rows(rows.limit(0), "id", "n").count() == 0


def test_a_feature_without_edges_is_reported(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(4) if abs(i - j) == 1], "src long, dst long, w double")
    expr = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (5, "b", 3.0)], "id long, gene string, value double")
    rows = {r["gene"]: r["stat"] for r in autocorr.statistic(edges, nodes, expr, "moran").collect()}
    values = [0, 0, 0, 0, 0, 3.0]
    mean = sum(values) / 6
    gaps = [v - mean for v in values]
    moran = 6 / 6 * sum(gaps[i] * gaps[j] for i in range(4) for j in range(4) if abs(i - j) == 1) / sum(g * g for g in gaps)
    assert set(rows) == {"a", "b"} and abs(rows["b"] - moran) < 1e-12
