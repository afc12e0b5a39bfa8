"""Mask morphology and tissue detection against plain loops, for several block sizes."""

import numpy as np
import pytest
from test_segmentation import arrays, discs, frame, plain_components

from tesserae.operators import blocks as bl
from tesserae.operators import morphology as mo
from tesserae.operators import tissue


def plain_dilate(mask, r):
    out = np.zeros_like(mask)
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dy * dy + dx * dx <= r * r and 0 <= y + dy < h and 0 <= x + dx < w:
                    out[y + dy, x + dx] = True
    return out


def masks():
    rng = np.random.default_rng(4)
    return [rng.random((40, 33)) < 0.15, rng.random((25, 50)) < 0.7, np.zeros((9, 9), bool), np.ones((9, 9), bool)]


@pytest.mark.parametrize(("size", "radius"), [(7, 3), (64, 5)])
def test_discs(spark, size, radius):
    images = bl.to_blocks(frame(spark, *[m.astype(float) for m in masks()]), size)
    grown, shrunk, closed = (arrays(f(images, radius)) for f in (mo.dilate, mo.erode, mo.close))
    for i, mask in enumerate(masks()):
        dilated = plain_dilate(mask, radius)
        assert np.array_equal(grown[f"i{i}"] > 0, dilated)
        assert np.array_equal(shrunk[f"i{i}"] > 0, ~plain_dilate(~mask, radius))
        assert np.array_equal(closed[f"i{i}"] > 0, ~plain_dilate(~dilated, radius))


def test_holes_and_margins(spark):
    mask = discs(60, 60, (30, 30, 22))
    mask[30, 30] = mask[20, 20:23] = False
    mask[40:44, 30:36] = False
    images = bl.to_blocks(frame(spark, mask.astype(float)), 17)
    for share in (0.001, 0.01):
        holes = plain_components(~mask, False)
        value, n = np.unique(holes[holes > 0], return_counts=True)
        expected = mask | np.isin(holes, value[n < int(share * 3600)])
        assert np.array_equal(arrays(mo.fill_holes(images, share))["i0"] > 0, expected)
    expected = mask.copy()
    expected[:10] = expected[-20:] = expected[:, :12] = False
    assert np.array_equal(arrays(mo.clear_border(images, (10, 20, 12, 0)))["i0"] > 0, expected)
    assert np.array_equal(arrays(mo.clear_border(images, (30, 30, 0, 0)))["i0"] > 0, mask)


def test_resizing(spark):
    a = np.arange(12.0 * 7).reshape(12, 7)
    sizes = spark.createDataFrame([("i0", 31, 20)], "img string, h long, w long")
    expected = a[np.clip(np.round(np.arange(31) / (31 / 12)).astype(int), 0, 11)][:, np.clip(np.round(np.arange(20) / (20 / 7)).astype(int), 0, 6)]
    for size in (5, 64):
        assert np.array_equal(arrays(bl.resize_nearest(bl.to_blocks(frame(spark, a), size), sizes))["i0"], expected)


def test_margins():
    assert tissue.margins_of(3, 10, 10) == (3, 3, 3, 3)
    assert tissue.margins_of(5, 10, 10) == (0, 0, 0, 0)
    assert tissue.margins_of((1, 2, 3, 4), 10, 10) == (1, 2, 3, 4)
    assert tissue.scaled_margins((10, 20, 30, 40), (100, 200), (50, 50)) == (5, 10, 8, 10)
    assert tissue.scaled_margins((40, 50, 0, 0), (100, 100), (1, 1)) == (0, 0, 0, 0)
    for wrong, error in (("3", TypeError), ((1, 2), ValueError), (-1, ValueError)):
        with pytest.raises(error):
            tissue.margins_of(wrong, 10, 10)


def slide(bright):
    img = np.full((80, 100), 240.0 if bright else 10.0)
    rng = np.random.default_rng(1)
    img += rng.integers(0, 5, img.shape)
    for part in ((25, 25, 16), (55, 70, 18)):
        img[discs(80, 100, part)] = 120.0 + rng.integers(0, 5)
    img[discs(80, 100, (8, 90, 2))] = 120.0  # a speck
    img[25, 25] = img[0, 0]  # a hole
    return img


@pytest.mark.parametrize("bright", [True, False])
def test_slides(spark, bright):
    pixels = frame(spark, np.stack([slide(bright)] * 3)).drop("img")
    rows = tissue.detect_tissue(pixels, min_specimen_share=0.0005, hole_share=0.001, n_samples=2, size=32).collect()
    got = np.zeros((80, 100), int)
    for r in rows:
        got[r.y, r.x] = r.label
    assert np.array_equal(got == 1, discs(80, 100, (55, 70, 18))) and np.array_equal(got == 2, discs(80, 100, (25, 25, 16)))
    if not bright:
        return
    small = tissue.detect_tissue(pixels, min_specimen_share=0.01, n_samples=5, max_pixels=2000, smoothing_cycles=2, border_margin=4, size=16).collect()
    back = np.zeros((80, 100), bool)
    for r in small:
        back[r.y, r.x] = True
    assert (back == (got > 0)).mean() > 0.97 and not back[:4].any()


def test_no_tissue(spark):
    flat = frame(spark, np.ones((8, 8))).drop("img")
    assert tissue.detect_tissue(flat).collect() == []
    assert tissue.detect_tissue(flat.limit(0)).collect() == []
