"""Connected components: stars made by tasks, odd graphs, and the work of a round."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import components


def brute(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and root[a] != root[b]:
            x, y = root[a], root[b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return root


def graphs():
    rng = random.Random(5)
    hub = [(9_000, i) for i in range(400)] + [(-7, i) for i in range(500, 900)] + [(9_000, 500)]
    path = [(i, i + 1) for i in range(10_000, 10_120)]
    rng.shuffle(path)
    some = [(rng.randrange(20_000, 20_300), rng.randrange(20_000, 20_300)) for _ in range(260)]
    return hub + path + some + some[:40] + [(5, 5), (31_000, 31_000)]


@pytest.mark.parametrize("chunk", [7, components.CHUNK])
def test_odd_graphs(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    edges = graphs()
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = [(r["node"], r["component"]) for r in components.connected_components(df).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == brute(edges)


def test_nodes_that_are_no_numbers(spark):
    edges = [(1, "b", "a"), (1, "c", "b"), (2, "a", "c"), (1, "c", "a"), (2, "d", "c"), (2, "d", "d")]
    df = spark.createDataFrame(edges, "k int, x string, y string").select(F.struct("k", F.col("x").alias("id")).alias("a"), F.struct("k", F.col("y").alias("id")).alias("b"))
    got = {(*r["node"], *r["component"]) for r in components.connected_components(df).collect()}
    assert got == {(1, x, 1, "a") for x in "abc"} | {(2, x, 2, "a") for x in "acd"}


def test_contract():
    rng = np.random.default_rng(3)
    u, v = rng.integers(-50, 50, (2, 60))
    u, v = u[u != v], v[u != v]
    nodes, roots = components.contract(u, v)
    want = brute(list(zip(u.tolist(), v.tolist(), strict=True)))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {k: r for k, r in want.items() if k != r}
    assert [len(x) for x in components.contract(u[:0], v[:0])] == [0, 0]
    leaves = np.arange(2000)
    assert (components.contract(np.full(2000, 2000), leaves)[1] == 0).all()


def test_few_tasks(spark):
    """Hubs and short paths settle in few rounds, and a round in few stages; the version before took 384 tasks for this."""
    hubs = [(k % 3, 10 + k) for k in range(600)] + [(2, 10)]
    edges = spark.createDataFrame(hubs + [(5_000 + k, 5_000 + k + j) for k in range(0, 3_000, 10) for j in (1, 2)], "a long, b long").repartition(4)
    held = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("components", "")
        assert components.connected_components(edges).where("component <> node").count() == 600 + 600 + 1
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 200, tasks
