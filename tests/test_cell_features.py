"""Features of cells against arrays, and the draw of random points."""

import numpy as np
import pytest

from tesserae.operators import cell_features, patterns

RASTER = np.array([[1, 1, 0, 2, 0], [1, 0, 0, 0, 3], [1, 1, 1, 0, 3], [0, 0, 4, 4, 3]])
VALUES = np.array([[10.0, 250, 7, 9, 1], [30, 40, 50, 60, 5], [200, 90, 31, 2, 5], [3, 4, 6, 6, 5]])


def _frames(spark, height=4):
    at = [(y, x) for y in range(4) for x in range(5)]
    labels = spark.createDataFrame([(y, x, int(RASTER[y, x])) for y, x in at], "y long, x long, label long")
    pixels = spark.createDataFrame([(y, x, 0, float(VALUES[y, x])) for y, x in at if y < height], "y long, x long, c int, val double")
    return labels, pixels


def _texture(label):
    ys, xs = np.nonzero(RASTER == label)
    box = (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
    mask, v = RASTER[box] == label, VALUES[box]
    lo, hi = v[mask].min(), v[mask].max()
    q = np.where(mask, np.round((v - lo) / (hi - lo) * 31) if hi > lo else 0, 0).astype(int)
    g = np.zeros((32, 32))
    for row in q:
        for a, b in zip(row[:-1], row[1:], strict=True):
            g[a, b] += 1
            g[b, a] += 1
    g = g / g.sum() if g.sum() else g
    i, j = np.indices(g.shape)
    return {"contrast": (g * (i - j) ** 2).sum(), "homogeneity": (g / (1 + (i - j) ** 2)).sum(), "ASM": (g * g).sum(), "energy": np.sqrt((g * g).sum())}


def test_against_arrays(spark):
    labels, pixels = _frames(spark)
    got = {(r["label"], r["feature"]): r["value"] for r in cell_features.cell_features(labels, pixels, drop_constant=False).collect()}
    assert len(got) == 4 * (12 + 4 + 6 + 16)
    for label in (1, 2, 3, 4):
        v = VALUES[RASTER == label]
        assert got[label, "area"] == len(v)
        assert got[label, "mean__0"] == pytest.approx(v.mean())
        assert got[label, "std__0"] == pytest.approx(v.std())
        for name, want in _texture(label).items():
            assert got[label, f"texture_{name}__0"] == pytest.approx(want), (label, name)
        hist = np.histogram(v, 16, (v.min(), v.max() if v.max() > v.min() else v.min() + 1))[0] / len(v)
        assert [got[label, f"histogram_bin{b}__0"] for b in range(16)] == pytest.approx(hist.tolist())


def test_cells_at_the_border_and_constants(spark):
    labels, pixels = _frames(spark, height=3)
    rows = cell_features.cell_features(labels, pixels, ["morphology:area", "summary"]).collect()
    assert {r["label"] for r in rows} == {1, 2}
    same = cell_features.cell_features(labels.where("label in (2, 4)"), None, ["morphology:extent", "morphology:area"])
    assert {r["feature"] for r in same.collect()} == {"area"}
    alone = cell_features.cell_features(labels.where("label = 4"), None, "morphology:extent")
    assert [r["value"] for r in alone.collect()] == [1.0]
    assert cell_features.cell_features(labels.where("label = 9"), pixels).count() == 0


@pytest.mark.parametrize("asked", [["morphology", "morphology:area"], "colour", "morphology:hair", []])
def test_requests_that_make_no_sense(asked):
    with pytest.raises(ValueError):
        cell_features.parse(asked)


def test_pixels_are_needed(spark):
    with pytest.raises(ValueError):
        cell_features.cell_features(_frames(spark)[0], None, "texture")


def test_random_points_fill_the_hull_alike_for_any_partitioning(spark):
    corners = [(0.0, 0.0), (100.0, 99.0), (100.0, 100.0)]
    draw = lambda: sorted(map(tuple, patterns.poisson_points(corners, 3, 40, spark, 5).collect()))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    one = draw()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert draw() == one
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert len(one) == 120
    assert all(0 <= x <= 100 and x * 0.99 - 1e-9 <= y <= x + 1e-9 for _, _, x, y in one)
    with pytest.raises(ValueError):
        patterns.poisson_points([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 1, 1, spark)
