"""The triangulation of a large library: as many triangles as its hull demands, in time that hardly grows faster than the points."""

import time

import numpy as np
import pytest

from tesserae.operators import graph, patterns


def test_a_large_library_in_time():
    k = np.arange(24_000, dtype=np.int64) * 25 + 7
    xy = np.column_stack([(k * 7919 % 10007) / 10.0, (k * 104729 % 10009) / 10.0])
    began = time.time()
    made = graph.delaunay_triangles(xy)
    assert time.time() - began < 45
    # Points on a side of the hull, which are no corners of it, take a triangle each.
    assert 0 <= 2 * len(xy) - 2 - len(patterns.hull(xy)) - len(made) < 100


@pytest.mark.parametrize("sweep", [1, 7, 10**9])
def test_passed_triangles_change_nothing(monkeypatch, sweep):
    rows = lambda t: sorted(map(tuple, np.sort(t, 1).tolist()))
    xy = np.unique(np.random.default_rng(3).integers(0, 20, (200, 2)), axis=0).astype(float)
    monkeypatch.setattr(graph, "SWEEP", 10**9)
    whole = graph.delaunay_triangles(xy)
    monkeypatch.setattr(graph, "SWEEP", sweep)
    assert rows(graph.delaunay_triangles(xy)) == rows(whole)
