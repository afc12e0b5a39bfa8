"""Labels and shapes on other grids against plain loops over pixels."""

import math

import numpy as np
import pytest

from tesserae.operators import alignment, cell_features, physical

COLUMNS = "element string, system string, xx double, xy double, xo double, yx double, yy double, yo double"


def _matrix(xx, xy, xo, yx, yy, yo, **more):
    return {"xx": xx, "xy": xy, "xo": xo, "yx": yx, "yy": yy, "yo": yo, "tx": None, "ty": None, **more}


def _turn(degrees, scale, xo, yo):
    c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    return _matrix(c, -s, xo, s, c, yo)


def _rows(df):
    return sorted(map(tuple, df.select("y", "x", "label").collect()))


def _raster(spark, a):
    return spark.createDataFrame([(y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y long, x long, label long")


def _back(m):
    whole = np.array([[m["xx"], m["xy"], m["xo"]], [m["yx"], m["yy"], m["yo"]], [0, 0, 1]])
    return np.linalg.inv(whole)


def test_relative_transforms(spark):
    rng = np.random.default_rng(3)
    a, b, c = (rng.normal(size=6).tolist() for _ in range(3))
    known = spark.createDataFrame(
        [("i", "global", *a), ("i", "aa", *b), ("l", "global", *c), ("l", "aa", *a), ("k", "zz", *b), ("k", "aa", *c), ("flat", "global", 1.0, 2.0, 0.0, 2.0, 4.0, 0.0), ("near", "global", *[v + d for v, d in zip(a, (0, 0, 3 * a[0] - 2 * a[1], 0, 0, 3 * a[3] - 2 * a[4]), strict=True)]), ("far", "other", *a)],
        COLUMNS,
    )
    pairs = spark.createDataFrame([("i", "l"), ("i", "k"), ("flat", "l"), ("i", "near"), ("i", "far"), ("i", None)], "image string, labels string")
    got = {(r["image"], r["labels"]): r for r in alignment.relative(known, pairs).collect()}
    assert len(got) == 6
    full = lambda v: np.array([[v[0], v[1], v[2]], [v[3], v[4], v[5]], [0, 0, 1]])
    for key, system, image, labels in ((("i", "l"), "global", a, c), (("i", "k"), "aa", b, c)):
        r = got[key]
        assert r["system"] == system and r["tx"] is None
        want = np.linalg.inv(full(image)) @ full(labels)
        assert [r[k] for k in alignment.MATRIX] == pytest.approx(want[:2].ravel().tolist(), rel=1e-9, abs=1e-9)
    # What is moved by three pixels right and two up in the image's own directions is a shift of whole pixels.
    assert (got["i", "near"]["tx"], got["i", "near"]["ty"]) == (3, -2)
    assert got["flat", "l"]["xx"] is None and got["i", "far"]["system"] is None and got["i", None]["system"] is None
    with pytest.raises(ValueError, match="share no"):
        alignment.between(known, "i", "far")
    with pytest.raises(ValueError, match="inverted"):
        alignment.between(known, "flat", "l")


@pytest.mark.parametrize("m", [_turn(30, 1.3, 4.2, -3.1), _turn(-75, 0.6, 0.0, 9.9), _matrix(-2.5, 0.0, 30.0, 0.0, 3.0, 0.0), _matrix(1.0, 0.5, 0.25, -0.5, 0.75, 7.0), _matrix(0.0, 1.0, 0.25, 1.0, 0.0, 0.5)])
def test_resampling(spark, m):
    a = np.random.default_rng(5).integers(0, 4, size=(9, 13))
    want, back = [], _back(m)
    for y in range(-70, 80):
        for x in range(-70, 80):
            u, v, _ = back @ (x + 0.5, y + 0.5, 1)
            i, j = math.floor(v), math.floor(u)
            if 0 <= i < 9 and 0 <= j < 13 and a[i, j]:
                want.append((y, x, int(a[i, j])))
    got = _rows(alignment.resample(_raster(spark, a), m))
    assert got == sorted(want)


def _star(rng, cx, cy, low, high, n):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = rng.uniform(low, high, n)
    return [(float(cx + r * math.cos(t)), float(cy + r * math.sin(t))) for r, t in zip(far, angles, strict=True)]


def _inside(rings, px, py):
    odd = False
    for ring in rings:
        for (x, y), (ex, ey) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y <= py) != (ey <= py) and x + (py - y) * ((ex - x) / (ey - y)) <= px:
                odd = not odd
    return odd


def test_polygons(spark):
    rng = np.random.default_rng(11)
    shapes = {k: [_star(rng, *rng.uniform(-20, 20, 2), 2, 12, int(rng.integers(3, 9))) for _ in range(1 + k % 2)] for k in range(1, 9)}
    shapes[20] = [[(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)]]  # corners on middles
    shapes[21] = [[(4.5, 0.5), (8.5, 0.5), (8.5, 3.5), (4.5, 3.5)]]  # shares a side with the one before
    shapes[22] = [[(1.0, 1.0), (9.0, 1.0)]]  # no area
    rows = [(k, r, i, x, y) for k, rings in shapes.items() for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    rows += [(20, 0, 9, *shapes[20][0][0]), (23, 0, 0, None, 1.0), (21, 0, 9, 3.0, None)]  # a ring closed by hand, places unknown
    vertices = spark.createDataFrame(rows, "label long, ring long, k long, x double, y double")
    spans = alignment.polygon_spans(vertices)
    got = sorted((r["label"], r["y"], x) for r in spans.collect() for x in range(r["x0"], r["x1"]))
    want = sorted((k, y, x) for k, rings in shapes.items() for y in range(-40, 40) for x in range(-40, 40) if _inside(rings, x + 0.5, y + 0.5))
    assert got == want
    assert sum(k == 20 for k, _, _ in got) == sum(k == 21 for k, _, _ in got) == 12
    top = {}
    for k, y, x in want:
        top[y, x] = max(k, top.get((y, x), 0))
    assert _rows(alignment.paint(spans)) == sorted((y, x, k) for (y, x), k in top.items())
    window = spark.createDataFrame([(-3, 2, 9, 6)], "y0 long, x0 long, y1 long, x1 long")
    assert _rows(alignment.paint(spans, window)) == sorted((y, x, k) for (y, x), k in top.items() if -3 <= y < 9 and 2 <= x < 6)
    assert alignment.paint(alignment.polygon_spans(vertices.limit(0))).count() == 0
    image = spark.createDataFrame([(y, x, 0, float(y * 100 + x)) for y in range(-40, 40) for x in range(-40, 40)], "y long, x long, c int, val double")
    under = alignment.span_pixels(spans, image).collect()
    assert sorted((r["label"], r["y"], r["x"]) for r in under) == want and all(r["val"] == r["y"] * 100 + r["x"] for r in under)


@pytest.mark.parametrize("m", [None, _turn(20, 1.7, 3.0, 1.0), _matrix(1.0, 0.8, 0.3, 0.0, 0.5, 0.0)])
def test_discs(spark, m):
    discs = [(1, 0.0, 0.0, 5.0), (2, 3.3, 7.1, 2.4), (3, 1.5, 1.5, 0.0), (4, -8.0, 2.0, 0.3), (5, None, 1.0, 3.0), (6, 1.0, 1.0, None)]
    got = sorted((r["label"], r["y"], x) for r in alignment.disc_spans(spark.createDataFrame(discs, "label long, x double, y double, radius double"), m).collect() for x in range(r["x0"], r["x1"]))
    back, want = _back(m or alignment.IDENTITY), []
    for k, cx, cy, radius in discs[:4]:
        for y in range(-30, 40):
            for x in range(-30, 40):
                u, v, _ = back @ (x + 0.5, y + 0.5, 1)
                if (u - cx) ** 2 + (v - cy) ** 2 <= radius**2:
                    want.append((k, y, x))
    assert got == sorted(want)


def test_features_of_shapes_and_of_shifted_labels(spark):
    rng = np.random.default_rng(2)
    a = np.zeros((24, 30), int)
    for k in range(12):
        a[2 + k // 4 * 7 : 7 + k // 4 * 7, 1 + k % 4 * 7 : 6 + k % 4 * 7] = k + 1
    a[3, 2] = a[10, 10] = 0
    image = spark.createDataFrame([(y, x, 0, float(v)) for y, row in enumerate(rng.integers(0, 200, size=a.shape)) for x, v in enumerate(row)], "y long, x long, c int, val double")
    window = alignment.image_window(image)
    features = lambda labels: {(r["label"], r["feature"]): r["value"] for r in cell_features.cell_features(labels, image).collect()}
    aligned = features(_raster(spark, a))
    known = spark.createDataFrame([("image", "global", 2.0, 0.0, 8.0, 0.0, 2.0, -4.0), ("labels", "global", 2.0, 0.0, 0.0, 0.0, 2.0, 2.0)], COLUMNS)
    m = alignment.between(known, "image", "labels")
    assert (m["tx"], m["ty"]) == (-4, 3)
    moved = _raster(spark, a).selectExpr("y - 3 as y", "x + 4 as x", "label")
    assert features(alignment.align(moved, window, m)) == pytest.approx(aligned)
    # Cells that the shift takes over the border go, and are counted.
    cut = alignment.align(_raster(spark, a), window, m)
    assert {r["label"] for r in cut.collect()} == {2, 3, 4, 6, 7, 8, 10, 11, 12}
    assert {r["place"]: r["n"] for r in alignment.dropped(_raster(spark, a), window, m).collect()} == {"inside": 9, "partial": 3}
    # The same cells as polygons: squares with holes of one pixel.
    square = lambda k, r, y, x, n: [(k, r, i, float(x + n * (i in (1, 2))), float(y + n * (i > 1))) for i in range(4)]
    vertices = [v for k in range(12) for v in square(k + 1, 0, 2 + k // 4 * 7, 1 + k % 4 * 7, 5)] + square(1, 1, 3, 2, 1) + square(6, 1, 10, 10, 1)
    shapes = spark.createDataFrame(vertices, "label long, ring long, k long, x double, y double")
    back = {"xx": 0.5, "xy": 0.0, "xo": 1.0, "yx": 0.0, "yy": 0.5, "yo": -2.0}
    there = {"xx": 2.0, "xy": 0.0, "xo": -2.0, "yx": 0.0, "yy": 2.0, "yo": 4.0}
    assert features(alignment.paint(alignment.polygon_spans(alignment.moved(alignment.moved(shapes, there), back)), window)) == pytest.approx(aligned, abs=1e-6)  # a square's eccentricity is rounding


def test_what_cannot_be_aligned(spark):
    labels = _raster(spark, np.ones((3, 4), int))
    window = spark.createDataFrame([(0, 0, 5, 5)], "y0 long, x0 long, y1 long, x1 long")
    half = _matrix(1.0, 0.0, 0.5, 0.0, 1.0, 0.0)
    with pytest.raises(ValueError, match="different pixel grids"):
        alignment.align(labels, window, half)
    assert alignment.align(labels, window, half, "rasterize").count() == 12
    # Resampled cells at the border keep what is inside.
    assert alignment.align(labels, window, _matrix(1.0, 0.0, 3.25, 0.0, 1.0, 0.0), "rasterize").count() == 6
    for m, mode in ((_matrix(1.0, 0.0, 9.0, 0.0, 1.0, 0.0, tx=9, ty=0), "strict"), (_matrix(2.0, 0.0, 90.0, 0.0, 1.0, 0.0), "rasterize"), (half, "nearest"), (_matrix(1.0, 1.0, 0.0, 1.0, 1.0, 0.0), "rasterize")):
        with pytest.raises(ValueError):
            alignment.align(labels, window, m, mode)


def test_microns_per_pixel(spark):
    m = _turn(25, 1.5, 3.0, -2.0)
    discs = spark.createDataFrame([(i, 4.0 * (i % 6), 4.0 * (i // 6), 1.0 + 0.1 * (i % 3)) for i in range(36)], "label long, x double, y double, radius double")
    assert physical.microns_per_pixel(discs, m, between_centers=100.0) == pytest.approx(100 / 6)
    assert physical.microns_per_pixel(discs, m, diameter=55.0) == pytest.approx(55 / (2.2 * 1.5))
    corners = lambda k, points: [(k, 0, i, x, y) for i, (x, y) in enumerate(points)]
    turned = [v for k in range(5) for v in corners(k, [(9.0 * k + 3 * a - 2 * b, 2 * a + 3 * b) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])]
    schema = "label long, ring long, k long, x double, y double"
    squares = spark.createDataFrame(turned, schema)
    assert physical.microns_per_pixel(squares, m, square_edge=8.0) == pytest.approx(8 / (math.sqrt(13) * 1.5))
    assert physical.microns_per_pixel(squares, m, between_centers=8.0) == pytest.approx(8 / (9 * 1.5))
    ring = spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 4.0)])] + [(1, 1, i, x, y) for i, (x, y) in enumerate([(5.0, 1.0), (7.0, 1.0), (7.0, 3.0), (5.0, 3.0)])], schema)
    r = physical.polygon_measures(ring).first()
    assert (r["area"], r["x"], r["y"]) == pytest.approx((28.0, (32 * 4 - 4 * 6) / 28, 2.0))
    hexagons = spark.createDataFrame(corners(1, [(math.cos(i * math.pi / 3), math.sin(i * math.pi / 3)) for i in range(6)]), schema)
    wrong = [(discs, m, {}), (discs, m, {"diameter": 1.0, "between_centers": 1.0}), (discs, m, {"square_edge": 1.0}), (squares, m, {"diameter": 1.0}), (discs.drop("radius"), m, {"diameter": 1.0}), (hexagons, m, {"square_edge": 1.0}), (discs, _matrix(1.0, 0.0, 0.0, 0.0, 1.1, 0.0), {"diameter": 1.0}), (discs.limit(1), m, {"between_centers": 1.0}), (discs.limit(0), m, {"diameter": 1.0})]
    for shapes, through, known in wrong:
        with pytest.raises(ValueError):
            physical.microns_per_pixel(shapes, through, **known)
