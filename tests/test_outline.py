"""Outlines and cut scores against plain loops, and on cut and whole ellipses."""

import math

import numpy as np
import pytest

from tesserae.functions import stats
from tesserae.operators import outline, qc


def label_frame(spark, a):
    return spark.createDataFrame([(int(y), int(x), int(a[y, x])) for y, x in zip(*np.nonzero(a), strict=True)], "y long, x long, label long")


def sides_of(mask):
    out = []
    for y, x in zip(*np.nonzero(mask), strict=True):
        for (my, mx), ((sy, sx), (ey, ex)) in outline._SIDES.items():
            ny, nx = y + my, x + mx
            if not (0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx]):
                m = (2 * y + my, 2 * x + mx)
                out.append((*m, m[0] + sy, m[1] + sx, m[0] + ey, m[1] + ex))
    return np.array(out)


def plain_longest(points, tolerance):
    """Every start, every end, every point between."""
    n, best = len(points), (0.0, 0.0)
    for s in range(n):
        for gap in range(2, n):
            p, q = points[s], points[(s + gap) % n]
            d0, d1 = q[0] - p[0], q[1] - p[1]
            length = math.sqrt(d0 * d0 + d1 * d1)
            if length < 1e-12:
                continue
            off = max(abs(d0 * (points[(s + k) % n][1] - p[1]) - d1 * (points[(s + k) % n][0] - p[0])) / length for k in range(1, gap))
            if off > tolerance:
                break
            a = abs(math.atan2(d0, d1)) % math.pi
            best = max(best, (length, 1 - min(a, abs(a - math.pi / 2), abs(a - math.pi)) / (math.pi / 4)))
    return best


def ellipse(h, w, cy, cx, a, b, angle):
    y, x = np.mgrid[:h, :w]
    dy, dx = y - cy, x - cx
    u, v = dx * math.cos(angle) + dy * math.sin(angle), dy * math.cos(angle) - dx * math.sin(angle)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


def test_trace_of_holes_and_corners():
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert sorted(map(len, outline.trace(sides_of(ring)))) == [4, 20]
    corner = np.zeros((4, 4), bool)
    corner[1, 1] = corner[2, 2] = True
    assert sorted(map(len, outline.trace(sides_of(corner)))) == [4, 4]  # pixels that meet at a corner are apart
    for points in outline.trace(sides_of(ring)):
        steps = np.abs(np.diff(np.concatenate([points, points[:1]]), axis=0))
        assert steps.max() <= 1 and (steps.sum(axis=1) > 0).all()


def test_longest_chord_against_plain_loops():
    rng = np.random.default_rng(1)
    for _ in range(25):
        mask = ellipse(30, 30, 15, 15, rng.uniform(3, 11), rng.uniform(3, 11), rng.uniform(0, 3))
        if rng.random() < 0.5:
            mask[: int(rng.integers(8, 16))] = False
        points = max(outline.trace(sides_of(mask)), key=len)
        got, expected = outline.longest_straight(points, 0.75), plain_longest(points.tolist(), 0.75)
        assert got == pytest.approx(expected)


def test_resampling_keeps_length():
    points = max(outline.trace(sides_of(ellipse(200, 200, 100, 100, 90, 70, 0.3))), key=len)
    few = outline.resampled(points, 120)
    assert len(few) == 119
    assert outline.longest_straight(few, 0.75)[0] == pytest.approx(outline.longest_straight(points, 0.75)[0], rel=0.5)


SIDE, BORDER = 432, 205


def cut_and_whole(cut):
    rng = np.random.default_rng(7)
    labels = np.zeros((SIDE, SIDE), int)
    n = 0
    for cy in range(12, SIDE, 24):
        for cx in range(12, SIDE, 24):
            n += 1
            labels[ellipse(SIDE, SIDE, cy + rng.integers(-2, 3), cx + rng.integers(-2, 3), rng.integers(6, 11), rng.integers(6, 11), rng.uniform(0, 3))] = n
    ids = labels.copy()
    if cut:
        for border in (BORDER,):
            ids[border - 1 : border + 1] = 0
            ids[:, border - 1 : border + 1] = 0
        y, x = np.mgrid[:SIDE, :SIDE]
        ids = np.where(ids > 0, ids * 9 + np.digitize(y, (BORDER,)) * 3 + np.digitize(x, (BORDER,)), 0)
        pieces = {}
        for i in np.unique(ids[ids > 0]).tolist():
            pieces.setdefault(i // 9, []).append(i)
        return ids, {i for p in pieces.values() if len(p) > 1 for i in p}
    return ids, set()


def test_cut_cells_score_higher(spark):
    ids, cut = cut_and_whole(True)
    rows = qc.tiling_qc(label_frame(spark, ids)).collect()
    scored = {r["label"]: r for r in rows if r["cut_score"] is not None}
    mean = lambda some: sum(scored[i]["cut_score"] for i in some) / len(some)
    assert mean(cut & scored.keys()) > 1.25 * mean(scored.keys() - cut)
    found = {r["label"] for r in rows if r["is_outlier"]}
    assert len(found) > 10 and len(found & cut) / len(found) > 0.8
    for r in rows:
        assert 0 <= r["nhood_outlier_fraction"] <= 1
        assert (r["cut_score"] is None) == (r["area"] < 20)
        if r["cut_score"] is not None:
            assert r["cut_score"] == pytest.approx(r["max_straight_edge_ratio"] * r["cardinal_alignment_score"])


def test_whole_cells_hardly_stand_out(spark):
    ids, _ = cut_and_whole(False)
    rows = qc.tiling_qc(label_frame(spark, ids)).collect()
    assert sum(r["is_outlier"] for r in rows) <= len(rows) * 0.1


def test_few_cells_and_arguments(spark):
    one = label_frame(spark, np.pad(np.ones((6, 6), int), 1))
    row = qc.tiling_qc(one).first()
    assert (row["is_outlier"], row["nhood_outlier_fraction"]) == (False, 0.0)
    assert row["smoothed_cut_score"] == row["cut_score"] > 0
    assert qc.tiling_qc(one.limit(0)).collect() == []
    for wrong in ({"n_neighbors": 0}, {"nmads_cut": 0}, {"nmads_cut": None, "nmads_smoothed": None}):
        with pytest.raises(ValueError):
            qc.tiling_qc(one, **wrong)
    with pytest.raises(ValueError):
        outline.cut_scores(one, max_points=2)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 1.0), rng.lognormal(3, 2, 400)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    for q in (0.0, 0.1, 0.5, 0.733, 1.0):
        assert stats.quantile(df, "v", q, rows=50) == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert stats.quantile(df.where("v is null"), "v", 0.5) is None


def plain_shape(mask):
    """Perimeters, Euler number, hull pixels and diameter by loops over a padded image."""
    m = np.pad(mask, 2).astype(int)
    h, w = m.shape
    near = lambda a, y, x: (a[y - 1, x], a[y + 1, x], a[y, x - 1], a[y, x + 1])
    border = np.zeros_like(m)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            border[y, x] = m[y, x] and not all(near(m, y, x))
    perimeter = crofton = 0.0
    parts = len(set(components(m > 0, True).ravel().tolist())) - 1
    holes = len(set(components(m == 0, False).ravel().tolist())) - 2
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            if border[y, x]:
                diagonal = sum(border[y + i, x + j] for i in (-1, 1) for j in (-1, 1))
                perimeter += outline.BORDER_LENGTHS.get(1 + 2 * sum(near(border, y, x)) + 10 * diagonal, 0.0)
            crofton += outline.CROFTON[m[y, x] + 2 * m[y - 1, x] + 4 * m[y, x - 1] + 8 * m[y - 1, x - 1]]
    points = np.array([(y + dy, x + dx) for y, x in zip(*np.nonzero(m), strict=True) for dy, dx in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])

    def inside(p):
        # In the hull: no line through two points has p strictly on one side and all points on the other.
        d = points - p
        angles = np.sort(np.arctan2(d[:, 0], d[:, 1]))
        return (np.abs(d).sum(axis=1) < 1e-12).any() or max(np.diff(angles).max(), 2 * math.pi - (angles[-1] - angles[0])) <= math.pi + 1e-9

    full = np.array([[inside(np.array([y, x])) for x in range(w)] for y in range(h)])
    edge = np.concatenate(outline.trace(sides_of(full)))
    diameter = max(math.dist(p, q) for p in edge.tolist() for q in edge.tolist())
    return perimeter, crofton, parts - holes, int(full.sum()), diameter


def components(mask, diagonal):
    from tesserae.operators.blocks import local_components

    return local_components(mask, diagonal)[0]


def test_shapes_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    ring = ellipse(26, 26, 12, 12, 10, 8, 0.4) & ~ellipse(26, 26, 12, 12, 4, 3, 1.0)
    shapes = [ring, ellipse(26, 26, 13, 12, 11, 4, 0.7), np.eye(26, dtype=bool), rng.random((26, 26)) < 0.3, np.pad(np.ones((4, 9), bool), ((3, 19), (5, 12))), np.pad(np.ones((1, 1), bool), ((3, 22), (5, 20)))]
    image = np.concatenate([s * (i + 1) for i, s in enumerate(shapes)], axis=1)
    labels = label_frame(spark, image)
    length = {r["label"]: r for r in outline.perimeters(labels).collect()}
    wide = {r["label"]: r for r in outline.hulls(labels).collect()}
    for i, shape in enumerate(shapes, 1):
        perimeter, crofton, euler, convex, diameter = plain_shape(shape)
        assert (length[i]["perimeter"], length[i]["perimeter_crofton"]) == pytest.approx((perimeter, crofton))
        assert length[i]["euler_number"] == euler
        assert (wide[i]["area"], wide[i]["area_convex"]) == (shape.sum(), convex)
        assert wide[i]["solidity"] == pytest.approx(shape.sum() / convex)
        assert wide[i]["feret_diameter_max"] == pytest.approx(diameter)
