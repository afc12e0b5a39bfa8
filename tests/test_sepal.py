"""Diffusion scores against one cell and one feature at a time."""

import math
import random

import pytest

from tesserae.operators import sepal


def plain(points, values, n_iter, dt, thresh):
    """Time of one feature on a square lattice with unit steps."""
    near = {i: [j for j, q in points.items() if abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1] for i, p in points.items()}
    inside = [i for i in sorted(points) if len(near[i]) == 4]
    level = {i: values.get(i, 0.0) for i in points}
    before = 1.0
    for step in range(n_iter):
        gain = {i: sum(level[j] for j in near[i]) - 4 * level[i] for i in inside}
        for i in points:
            if i not in gain:
                beside = [j for j in sorted(near[i]) if j in inside]
                gain[i] = gain[beside[0] if beside else min(inside, key=lambda j: (sum(abs(a - b) for a, b in zip(points[i], points[j])), j))]
        level = {i: max(level[i] + dt * gain[i], 0) for i in points}
        total = sum(level[i] for i in inside)
        shares = [level[i] / total for i in inside if level[i] > 0] if total else []
        now = -sum(p * math.log(p) for p in shares) / len(inside)
        if abs(now - before) <= thresh:
            return dt * step
        before = now
    return float("nan")


def test_diffusion_times(spark):
    rng = random.Random(4)
    points = {7 * x + y: (float(x), float(y)) for x in range(6) for y in range(7)}
    genes = {f"g{k}": {i: float(rng.randrange(1, 9)) for i in points if rng.random() < 0.3} for k in range(40)}
    genes["nowhere"] = {}
    frame = spark.createDataFrame([(lib, i + 1000 * lib, *p) for lib in (0, 1) for i, p in points.items()], "lib int, id long, x double, y double")
    rows = [(i, g, v) for g, own in genes.items() for i, v in own.items()] + [(1000, "nowhere", 0.0)]
    got = {(r["lib"], r["gene"]): r["score"] for r in sepal.sepal(frame, spark.createDataFrame(rows, "id long, gene string, value double"), max_neighs=4, n_iter=400, dt=0.01, thresh=1e-4).collect()}
    assert len(got) == 2 * len(genes)
    for g, own in genes.items():
        assert got[0, g] == pytest.approx(plain(points, own, 400, 0.01, 1e-4), nan_ok=True), g
        assert got[1, g] == pytest.approx(plain(points, {}, 400, 0.01, 1e-4), nan_ok=True)
