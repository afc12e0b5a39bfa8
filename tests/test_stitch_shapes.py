"""Stitching by shape on cells that lines cut, and the shapes of seams against arrays."""

import numpy as np
import pytest

from tesserae.operators import stitch_shapes
from tesserae.operators.stitch_shapes import Stitching

SEAMS = ((59, 60), (119, 120))  # rows and columns without labels


def _cut(spark, cells, size=180, gaps=True):
    """Ellipses ``cy, cx, ry, rx``; the pieces of cell k in tile (i, j) are labelled 100 k + 10 i + j."""
    y, x = np.mgrid[:size, :size]
    a = np.zeros((size, size), int)
    tile = lambda v: (v > 59).astype(int) + (v > 119)
    for k, (cy, cx, ry, rx) in enumerate(cells, 1):
        inside = ((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 <= 1
        a[inside] = (100 * k + 10 * tile(y) + tile(x))[inside]
    if gaps:
        for low, high in SEAMS:
            a[low : high + 1] = 0
            a[:, low : high + 1] = 0
    rows = [(int(i), int(j), int(a[i, j])) for i, j in np.argwhere(a)]
    return spark.createDataFrame(rows, "y long, x long, label long"), a


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group_id"], set()).add(r["label"])
        assert r["n_pieces"] >= 1 and (r["confidence"] is None) == (r["n_pieces"] == 1)
    return {min(g): g for g in out.values()}


def test_cut_cells_are_found(spark):
    cells = [(30, 60, 14, 16), (59, 25, 15, 12), (60, 60, 17, 17), (59, 95, 13, 14), (30, 150, 12, 12), (90, 90, 12, 12), (100, 30, 9, 9), (119, 150, 14, 14), (140, 119, 15, 11), (150, 30, 11, 11)]
    labels, a = _cut(spark, cells)
    got = _groups(stitch_shapes.stitch_by_shape(labels))
    pieces = {}
    for v in np.unique(a[a > 0]).tolist():
        pieces.setdefault(v // 100, set()).add(v)
    truth = {min(p): p for p in pieces.values()}
    cut = {k: p for k, p in truth.items() if len(p) > 1}
    right = sum(got.get(k) == p for k, p in cut.items())
    false = sum(len(g) > 1 and g != truth.get(k) for k, g in got.items())
    assert len(cut) == 6 and right >= 5 and not false
    assert got[300] == {300, 301, 310, 311}  # a corner
    assert all(got[k] == p for k, p in truth.items() if len(p) == 1)
    # Only candidates may join.
    some = labels.where("label <> 300").select("label")
    assert _groups(stitch_shapes.stitch_by_shape(labels, candidates=some))[300] == {300}
    assert all(len(g) == 1 for g in _groups(stitch_shapes.stitch_by_shape(labels, Stitching(max_size=1))).values())
    assert stitch_shapes.stitch_by_shape(labels.limit(0)).count() == 0


def test_closed_shapes(spark):
    labels, a = _cut(spark, [(59, 30, 15, 15), (110, 59, 10, 14)])
    points = np.argwhere((a == 100) | (a == 110))
    got = set(map(tuple, stitch_shapes.closed(points, 3).tolist()))
    disc = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
    own = set(map(tuple, points.tolist()))
    grown = {(y + i, x + j) for y, x in own for i, j in disc}
    assert got == {p for p in grown if all((p[0] + i, p[1] + j) in grown for i, j in disc)} and got > own
    # Pieces too far apart stay apart; the larger stays, the first of equal ones.
    assert stitch_shapes.closed(np.array([[0, 0], [0, 20], [1, 21], [9, 9]]), 0).tolist() == [[0, 20], [1, 21]]
    assert stitch_shapes.closed(np.array([[5, 9], [0, 3]]), 1).tolist() == [[0, 3]]
    pairs = spark.createDataFrame([(1, 100, 110), (2, 210, 211), (3, 110, 210)], "pair long, a long, b long")
    shape = {r["pair"]: r for r in stitch_shapes.merged_shapes(labels, pairs, 3).collect()}
    assert all(shape[k]["merge_solidity"] > 0.93 and shape[k]["merge_compactness"] > 0.8 for k in (1, 2))
    assert len(shape) == 3


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "group_id long, axis string, at_p long, at_q long, lo_p long, hi_p long, lo_q long, hi_q long")


def test_groups_that_no_cell_can_make(spark):
    rows = [
        (1, "h", 10, 13, 0, 9, 0, 9), (1, "h", 30, 33, 0, 9, 0, 9),  # a chain over two seams
        (2, "h", 10, 13, 0, 9, 0, 9), (2, "h", 10, 13, 10, 19, 10, 19),  # two cuts at one seam
        (3, "h", 10, 13, 0, 9, 0, 9), (3, "h", 10, 13, 13, 22, 13, 22), (3, "v", 9, 13, 0, 10, 0, 10), (3, "v", 9, 13, 13, 20, 13, 20),  # a corner
        (4, "h", 10, 13, 0, 9, 0, 9), (4, "h", 10, 13, 33, 42, 33, 42), (4, "v", 9, 13, 0, 10, 0, 10), (4, "v", 9, 13, 13, 20, 13, 20),  # sides end elsewhere
        (5, "h", 10, 13, 0, 9, 0, 9), (5, "v", 9, 13, 40, 50, 40, 50),  # three pieces around a bend
        (6, "h", 10, 13, 0, 9, 5, 14),  # two pieces
    ]
    sized = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 4), (5, 3), (6, 2)], "group_id long, n_pieces long")
    good = {r["group_id"] for r in stitch_shapes.plausible(_pairs(spark, rows), sized, 4.0).collect()}
    assert good == {1, 3, 5, 6}


@pytest.mark.parametrize("wrong", [{"max_gap": -1.0}, {"min_iou": 1.5}, {"max_size": 0}, {"min_confidence": -0.1}, {"close_radius": -1}])
def test_parameters(wrong):
    with pytest.raises(ValueError):
        Stitching(**wrong)
