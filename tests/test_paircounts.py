"""Counts of pairs made inside tasks against plain loops."""

import math

import numpy as np
import pytest

from tesserae.operators import paircounts, patterns


def cloud(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i // 2 if i < 6 else i, float(x), float(y), "abc"[i % 3] if i % 50 else None) for i, (x, y) in enumerate(rng.integers(0, 120, (n, 2)) / 2 - 20)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, c string").repartition(5)


def plain(rows, limits, alike=False):
    out = {}
    for i, x, y, c in rows:
        for j, u, v, d in rows:
            d2 = (x - u) * (x - u) + (y - v) * (y - v)
            if i != j and c and d and (c == d or not alike) and d2 <= limits[-1]:
                key = (c, d, next(k for k, limit in enumerate(limits) if d2 <= limit))
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("block", [16, 8192])
@pytest.mark.parametrize("alike", [False, True])
@pytest.mark.parametrize("limits", [[1.0, 25.0, 26.0, 400.0], [k * k / 4.0 for k in range(1, 30)], [1e4]])
def test_counts_are_those_of_a_loop(spark, monkeypatch, block, alike, limits):
    monkeypatch.setattr(paircounts, "BLOCK", block)
    rows, points = cloud(spark)
    got = {(r["cluster_i"], r["cluster_c"], r["k"]): r["n"] for r in paircounts.pair_counts(points, limits, alike).collect()}
    assert got == plain(rows, limits, alike)


def test_thresholds_are_the_last_doubles():
    place = lambda d2: np.ceil((np.sqrt(d2) - 0.0) / 0.7 - 1e-9)
    made = paircounts.thresholds(place, 5, 2.8**2)
    for k, limit in enumerate(made[:-1]):
        assert place(limit) <= k < place(math.nextafter(limit, math.inf))
    assert made[-1] == 2.8**2


def test_pairs_never_become_rows(spark):
    _, points = cloud(spark, 60)
    for made in (patterns.co_occurrence(points, [0.0, 10.0, 20.0], "c"), patterns.ripley_l(points, 3600.0, [0.0, 10.0, 20.0], "c")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "(dx" not in plan and "a_x" not in plan
