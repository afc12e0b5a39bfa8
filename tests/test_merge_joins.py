"""Joins of cells with cells stay away from the driver, however small their files are."""

import pytest

from tesserae.functions.stats import permuted
from tesserae.operators import graph_stats
from tesserae.operators.rangejoin import near_pairs


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(0, i, float(i % 7), float(i % 5), "ab"[i % 2]) for i in range(40)], "lib int, id long, x double, y double, cl string")


def merged(made) -> bool:
    made.collect()
    plan = made._jdf.queryExecution().toString()
    return "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_pairs(points):
    assert merged(near_pairs(points, points, 3.0))


def test_labels_of_edges(spark, points):
    edges = spark.createDataFrame([(0, 7, 8), (0, 8, 7)], "lib int, src long, dst long")
    assert merged(graph_stats._labelled(edges, points, "cl"))


def test_permuted_labels(points):
    assert merged(permuted(points, 3, 1, by=["lib"]))


def test_permuted_labels_without_strata(points):
    made = permuted(points, 3, 1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].lstrip(" +-").startswith("Join Inner") and "strategy=merge" in plan.splitlines()[1]
