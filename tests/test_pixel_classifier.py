"""The trained tissue mask: filters against plain sums, planted blobs, several block sizes."""

import numpy as np
import pytest
from test_segmentation import arrays, discs, frame, plain_distances

from tesserae.operators import blocks as bl
from tesserae.operators import tissue
from tesserae.operators.pixel_classifier import PixelClassifier, background_colors, corner_pixels, gaussian, responses, tissue_mask

SMALL = PixelClassifier(sigma_max=2.0, trees=15)


def slide():
    """Two blobs that differ from the ground by color and grain."""
    rng = np.random.default_rng(5)
    blob = discs(64, 72, (22, 20, 13), (44, 52, 12))
    return blob, np.stack([np.where(blob, 200.0 - 40 * c + rng.normal(0, 25, blob.shape), 120.0 + rng.normal(0, 6, blob.shape)) for c in range(3)])


def assert_blobs(got, blob):
    """Nothing is missed, and nothing is added but a rim: within two widths (of 2 pixels) of the widest filter."""
    assert not (blob & ~got).any()
    assert (plain_distances(~blob)[got & ~blob] <= 16).all()


def test_filters():
    rng = np.random.default_rng(1)
    a = rng.random((12, 9))
    weights = np.exp(-0.5 * (np.arange(-4, 5) / 1.0) ** 2)
    weights /= weights.sum()
    expected = sum(weights[i + 4] * weights[j + 4] * a[np.clip(np.arange(12) + i, 0, 11)][:, np.clip(np.arange(9) + j, 0, 8)] for i in range(-4, 5) for j in range(-4, 5))
    assert np.allclose(gaussian(a, 1.0), expected)
    assert len(responses(a[None], PixelClassifier())) == 20 and len(responses(a[None], PixelClassifier(edges=False))) == 15
    y, x = np.mgrid[:40, :40].astype(float)
    flat = responses((3 * y + 4 * x)[None], PixelClassifier(sigma_max=1.0))[:, 20, 20]
    assert np.allclose(flat, [140.0, 5.0, 0.0, 0.0])  # a slope of 5 without curvature
    curved = responses((y * y)[None], PixelClassifier(sigma_max=1.0))[:, 20, 20]
    assert np.allclose(curved[2:], [2.0, 0.0])
    with pytest.raises(ValueError):
        PixelClassifier(sigma_min=0).sigmas()


def test_corners():
    tile = bl.Tile("i", 0, 0, 10, 20, 10, 20)
    mask = corner_pixels(tile, (True, False, False, True), 0.2)
    assert mask.sum() == 16 and mask[:2, :4].all() and mask[-2:, -4:].all()
    assert corner_pixels(tile, (False,) * 4, 0.2).sum() == 1


def test_responses_and_colors_do_not_depend_on_blocks(spark):
    blob, image = slide()
    whole = responses(image, SMALL)
    for size in (17, 128):
        blocks = bl.to_blocks(frame(spark, image), size)
        got = arrays(bl.map_overlap(blocks, SMALL.depth(), lambda a, tile: (tile.inner(responses(a, SMALL)), 0.0)), 7)["i0"]
        assert np.allclose(got, whole[7])
        ground = np.concatenate([image[:, :6, :7].reshape(3, -1), image[:, :6, -7:].reshape(3, -1), image[:, -6:, :7].reshape(3, -1), image[:, -6:, -7:].reshape(3, -1)], 1)
        assert np.allclose(background_colors(blocks, (True,) * 4, 0.1), [(g.mean(), g.std()) for g in ground])


def test_planted_blobs(spark):
    blob, image = slide()
    found = [arrays(tissue_mask(bl.to_blocks(frame(spark, image), size), SMALL, share=0.1, margins=(2, 2, 2, 2), size=size))["i0"] > 0 for size in (30, 128)]
    assert np.array_equal(*found)
    assert_blobs(found[0], blob)
    assert not found[0][:2].any()
    rows = tissue.detect_tissue(frame(spark, image).drop("img"), tissue.Corners(share=0.1), n_samples=2, hole_share=0.01, classifier=SMALL, size=64).collect()
    got = np.zeros(blob.shape, int)
    for r in rows:
        got[r.y, r.x] = r.label
    assert set(np.unique(got)) == {0, 1, 2}
    assert_blobs(got > 0, blob)


def test_nothing_to_learn(spark):
    flat = frame(spark, np.ones((2, 8, 8))).drop("img")
    assert tissue.detect_tissue(flat, classifier=SMALL).collect() == []
    assert tissue.detect_tissue(flat.limit(0), classifier=SMALL).collect() == []
