"""Graphs and cluster statistics against small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import graph, graph_stats


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 3.0, 1.0), (0, 2, 5.0, 6.0), (0, 3, 0.0, 4.0)], "lib int, id long, x double, y double")


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_radius_is_inclusive(four):
    assert pairs(graph.Radius(5.0).build(four)) == [(0, 1), (0, 3), (1, 0), (1, 3), (3, 0), (3, 1)]


def test_knn_takes_all_others(four):
    assert len(pairs(graph.KNN(3).build(four))) == 12
    assert len(pairs(graph.KNN(5).build(four))) == 12


def test_diagonal_and_interval(four):
    rows = graph.Radius((3.5, 5.5), set_diag=True).build(four)
    assert pairs(rows) == [(0, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]


def test_delaunay(four):
    rows = {(r["src"], r["dst"]): round(r["dist"], 4) for r in graph.Delaunay().build(four).where("src < dst").collect()}
    assert rows == {(0, 1): 3.0, (0, 3): 3.0, (1, 2): 5.3852, (1, 3): 4.2426, (2, 3): 5.3852}


def test_rings_on_a_lattice(spark):
    points = spark.range(100).select(F.lit(0).alias("lib"), "id", (F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    one, three = graph.Grid(4).build(points), graph.Grid(4, n_rings=3).build(points)
    most = lambda df: df.groupBy("src").count().agg(F.max("count")).first()[0]
    assert (most(one), most(graph.Grid(4, n_rings=2).build(points)), most(three)) == (4, 12, 24)
    assert {r["dist"] for r in three.select("dist").distinct().collect()} == {1.0, 2.0, 3.0}


@pytest.fixture(scope="module")
def network(spark):
    rows = ["01100", "00001", "12000", "01001", "00120"]
    edges = [(0, i, j, float(w), 1.0) for i, row in enumerate(rows) for j, w in enumerate(row) if w != "0"]
    return spark.createDataFrame(edges, "lib int, src long, dst long, w double, dist double")


@pytest.mark.parametrize(("null", "weights", "expected"), [(False, True, [5, 1, 2, 3]), (False, False, [4, 1, 2, 2]), (True, True, [2, 1, 2, 3]), (True, False, [1, 1, 2, 2])])
def test_interaction_matrix(spark, network, null, weights, expected):
    labels = ["a", "a", "a", "b", "b"]
    nodes = spark.createDataFrame([(i, None if null and not i else c) for i, c in enumerate(labels)], "id long, cl string")
    got = {(r["cluster_src"], r["cluster_dst"]): r["value"] for r in graph_stats.interaction_matrix(network, nodes, weights=weights).collect()}
    assert [got[k] for k in (("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"))] == expected


def test_enrichment_ignores_partitioning(spark, network):
    nodes = spark.createDataFrame([(i, c) for i, c in enumerate("aabba")], "id long, cl string")
    got = [sorted(map(tuple, graph_stats.nhood_enrichment(network.repartition(n), nodes.repartition(n), n_perms=8, seed=1).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_centralities_of_a_path(spark):
    edges = spark.createDataFrame([(0, i, i + 1, 1.0, 1.0) for i in range(3)], "lib int, src long, dst long, w double, dist double")
    nodes = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "id long, cl string")
    got = {r["cluster"]: r.asDict() for r in graph_stats.centrality_scores(edges, nodes).collect()}
    assert got["a"]["degree_centrality"] == 0.5
    assert got["a"]["closeness_centrality"] == pytest.approx(2 / 3)
    assert got["a"]["average_clustering"] == 0.0


def test_mask_splits_the_edges(spark, four):
    edges = graph.KNN(3).build(four)
    square = [(-1.0, -1.0), (4.0, -1.0), (4.0, 5.0), (-1.0, 5.0)]
    inside, outside = graph.mask_edges(edges, four, square), graph.mask_edges(edges, four, square, negative=True)
    assert pairs(inside) == [(0, 1), (0, 3), (1, 0), (1, 3), (3, 0), (3, 1)]
    assert inside.count() + outside.count() == edges.count()
