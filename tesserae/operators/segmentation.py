"""Segmentation of images in blocks: watershed, and any function of chunks.

Watershed floods the mask from the peaks of its distance to the background.  Every
pixel joins the peak from which it is reached over the lowest rim, over the fewest steps along a
level, and then the peak with the least number.  The three conditions are
settled one after the other between blocks, and none depends on how the image is cut into
blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.stats import number_rows
from tesserae.operators import blocks as bl
from tesserae.operators.blocks import Tile
from tesserae.operators.images import otsu
from tesserae.session import materialise

#: Pixels around a block in which distances are looked for first.
FIRST_DEPTH = 32
_STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))
_LOW_BITS = 24
_OFFSET = 1 << 38
_FAR = np.iinfo(np.int64).max


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest one outside the mask, infinite without any.

    First along rows, then as the least of parabolas along columns, as far as they matter.
    """
    h, w = mask.shape
    x = np.arange(w)
    far = h + w + 1
    before = np.maximum.accumulate(np.where(mask, -far, x), axis=1)
    after = np.minimum.accumulate(np.where(mask, w + far, x)[:, ::-1], axis=1)[:, ::-1]
    near = np.minimum(x - before, after - x).astype(np.float64)
    near[near > w] = np.inf
    rows = near * near
    best = rows.copy()
    for dy in range(1, h):
        if dy * dy >= best.max():
            break
        np.minimum(best[dy:], rows[:-dy] + dy * dy, out=best[dy:])
        np.minimum(best[:-dy], rows[dy:] + dy * dy, out=best[:-dy])
    return best


def distance_transform(blocks: DataFrame, plane: int = 0, max_depth: int | None = None) -> DataFrame:
    """Adds a plane: the squared distance to the nearest pixel of the image that is not in the mask (0 or not there).

    A block looks ``FIRST_DEPTH`` pixels around itself; where that can't have been far
    enough, four times as far, until it is or the whole image has been seen.  Distances over
    ``max_depth`` need not be exact if it is given.
    """

    def at(depth: int):
        def run(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
            mask = np.nan_to_num(a[plane]) > 0
            d = tile.inner(squared_distances(mask))
            whole = a.shape[-2] == tile.ih and a.shape[-1] == tile.iw
            enough = whole or not (d > (depth + 1) ** 2).any()
            return np.concatenate([tile.inner(a), d[None]]), 0.0 if enough or (max_depth is not None and depth >= max_depth) else 1.0

        return run

    depth = FIRST_DEPTH if max_depth is None else min(FIRST_DEPTH, max_depth)
    made = materialise(bl.map_overlap(blocks, depth, at(depth)), "distances")
    done = made.where("stat = 0")
    left = made.where("stat > 0").select(*bl.KEYS)
    while not left.isEmpty():
        depth = depth * 4 if max_depth is None else min(depth * 4, max_depth)
        made = materialise(bl.map_overlap(blocks, depth, at(depth), left), "distances")
        done = done.unionByName(made.where("stat = 0"))
        left = made.where("stat > 0").select(*bl.KEYS)
    return done


def _shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``out[y, x] = a[y + dy, x + dx]``."""
    out = np.full_like(a, fill)
    h, w = a.shape
    ys, xs = slice(max(-dy, 0), min(h - dy, h)), slice(max(-dx, 0), min(w - dx, w))
    out[ys, xs] = a[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def _peaks(reach: int):
    """From planes mask and distance: a third plane of pixels that are highest around them.

    Pixels at the image's edge are no peaks and don't count; ``stat`` tells whether another mask pixel is none.
    """

    def run(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
        y = np.arange(tile.y0 - tile.top, tile.y0 - tile.top + a.shape[1])[:, None]
        x = np.arange(tile.x0 - tile.left, tile.x0 - tile.left + a.shape[2])[None, :]
        inside = (np.nan_to_num(a[0]) > 0) & (y > 0) & (y < tile.ih - 1) & (x > 0) & (x < tile.iw - 1)
        level = np.where(inside, a[1], -np.inf)
        highest = level
        for k in range(1, reach + 1):
            highest = np.maximum(highest, np.maximum(_shifted(level, k, 0, -np.inf), _shifted(level, -k, 0, -np.inf)))
        rows = highest
        for k in range(1, reach + 1):
            highest = np.maximum(highest, np.maximum(_shifted(rows, 0, k, -np.inf), _shifted(rows, 0, -k, -np.inf)))
        peak = tile.inner(inside & (level == highest))
        return np.concatenate([tile.inner(a)[:2], peak[None]]), float((tile.inner(inside) & ~peak).any())

    return run


def _flooded(key: np.ndarray, height: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Least keys (rim, steps on its level) that neighbors allow, until none falls any more."""
    while True:
        best = key
        for dy, dx in _STEPS:
            near = _shifted(key, dy, dx, _FAR)
            rim = near >> _LOW_BITS
            way = np.where(near == _FAR, _FAR, np.where(height > rim, height << _LOW_BITS, near + 1))
            best = np.minimum(best, np.where(mask, way, _FAR))
        if (best == key).all():
            return key
        key = best


#: Planes while flooding: mask, height, marker, rim, steps, label.
def _keys(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.nan_to_num(a[0]) > 0
    height = np.nan_to_num(a[1]).astype(np.int64)
    known = mask & (np.nan_to_num(a[3], nan=-1) >= 0)
    return np.where(known, (np.nan_to_num(a[3]).astype(np.int64) << _LOW_BITS) + np.nan_to_num(a[4]).astype(np.int64), _FAR), height, mask


def _with_keys(a: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = a.copy()
    there = key != _FAR
    out[3] = np.where(there, key >> _LOW_BITS, -1)
    out[4] = np.where(there, key & ((1 << _LOW_BITS) - 1), 0)
    return out


def _start(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
    mask = np.nan_to_num(a[0]) > 0
    height = np.where(mask & np.isfinite(a[1]), _OFFSET - np.nan_to_num(a[1], posinf=0.0), 0)
    marker = np.where(mask, a[2], 0)
    planes = np.stack([mask, height, marker, np.where(marker > 0, height, -1), np.zeros(mask.shape), np.zeros(mask.shape)])
    key, levels, inside = _keys(planes)
    return _with_keys(planes, _flooded(key, levels, inside)), 1.0


def _rise(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
    key, height, mask = _keys(a)
    new = tile.inner(_flooded(key, height, mask))
    return _with_keys(tile.inner(a), new), float((new != tile.inner(key)).any())


def _named(a: np.ndarray) -> np.ndarray:
    """Least labels along ways that give a pixel its key; peaks keep their own."""
    key, height, mask = _keys(a)
    marker = np.nan_to_num(a[2])
    label = np.where(marker > 0, marker, np.where(np.nan_to_num(a[5]) > 0, np.nan_to_num(a[5]), np.inf))
    free = mask & (marker == 0) & (key != _FAR)
    parents = []
    for dy, dx in _STEPS:
        near = _shifted(key, dy, dx, _FAR)
        way = np.where(near == _FAR, _FAR, np.where(height > (near >> _LOW_BITS), height << _LOW_BITS, near + 1))
        parents.append(free & (way == key))
    while True:
        best = label
        for (dy, dx), ok in zip(_STEPS, parents, strict=True):
            best = np.where(ok, np.minimum(best, _shifted(label, dy, dx, np.inf)), best)
        if (best == label).all():
            return np.where(np.isfinite(label), label, 0)
        label = best


def _name(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
    old = tile.inner(a)
    out = old.copy()
    out[5] = tile.inner(_named(a))
    return out, float((out[5] != np.nan_to_num(old[5])).any())


def number_labels(blocks: DataFrame, plane: int) -> DataFrame:
    """Numbers the labels of every image from 1, in their order."""
    there = materialise(bl.count_values(blocks, plane).select(*bl.KEYS, F.col("value").alias("old")), "labels")
    numbered = materialise(number_rows(there.select(F.struct("img", "old").alias("k")).distinct(), "k", "n").select("k.img", "k.old", "n"), "numbers")
    first = numbered.groupBy("img").agg((F.min("n") - 1).alias("before"))
    names = numbered.join(first, "img").select("img", "old", (F.col("n") - F.col("before")).alias("new"))
    return bl.relabel(blocks, plane, there.join(names, ["img", "old"]))


def watershed(blocks: DataFrame, thresh: float | None = None, above: bool = True, plane: int = 0) -> DataFrame:
    """One plane of labels, 0 for the background, numbered from 1 in the order of the peaks.

    The mask is what is at least ``thresh`` (Otsu's of each image if none is given), or
    what is less, with ``above=False``.  Peaks are highest among the 5 x 5 pixels around
    them; those that touch by sides are one; an image all of whose mask pixels are peaks, or
    without a background, has none, and then no labels.  Mask pixels that no peak reaches stay 0.
    """
    if thresh is None:
        values = bl.to_pixels(blocks, plane).select("img", "val")
        cuts = otsu(values, by=["img"])
        cut_blocks = blocks.join(cuts, "img", "left").withColumn("stat", F.coalesce("threshold", F.lit(np.inf))).select(bl.NAMES)
    else:
        cut_blocks = blocks.withColumn("stat", F.lit(float(thresh)))
    masks = materialise(_masks(cut_blocks, plane, above), "mask")
    peaks = materialise(bl.map_overlap(distance_transform(masks), 2, _peaks(2)), "peaks")
    plain = peaks.groupBy("img").agg((F.max("stat") == 0).alias("_plain"))
    judged = peaks.join(plain, "img").withColumn("stat", F.col("_plain").cast("double")).select(bl.NAMES)
    markers = bl.label_components(_stat_clears(judged), 2)
    risen = bl.settle(bl.map_blocks(markers, _start), _rise, "flood")
    named = bl.settle(risen.withColumn("stat", F.lit(1.0)), _name, "names")
    return number_labels(bl.map_blocks(named, lambda a, tile: (a[5:6], 0.0)), 0)


def _masks(blocks: DataFrame, plane: int, above: bool) -> DataFrame:
    """One plane, 1 in the mask; the threshold is each block's ``stat``."""

    def run(batches):
        for row in bl._rows(batches):
            a = bl._array(row)[plane]
            inside = (a >= row.stat) if above else (a < row.stat)
            yield bl._one(row, bl._tile(row), inside[None].astype(np.float64), 0.0)

    return blocks.mapInPandas(run, bl.SCHEMA)


def _stat_clears(blocks: DataFrame) -> DataFrame:
    """Empties the third plane of blocks whose ``stat`` is 1."""

    def run(batches):
        for row in bl._rows(batches):
            a = bl._array(row).copy()
            if row.stat:
                a[2] = 0
            yield bl._one(row, bl._tile(row), a, 0.0)

    return blocks.mapInPandas(run, bl.SCHEMA)


def segment_chunks(blocks: DataFrame, func: Callable[[np.ndarray], np.ndarray], depth: int = 30, boundary: str = "symmetric", merge: bool = True, same: Column | None = None) -> DataFrame:
    """One plane of labels from ``func``, called with every chunk (a block) and its surroundings.

    ``func`` gets height x width x channels and returns integers of height x width, 0 for
    background.  It sees ``depth`` pixels around the chunk; beyond the image they are
    mirrored (any mode of ``numpy.pad``).  Labels become unique by a shift that leaves
    room for the chunk's number; those that touch across a border become the least of them,
    unless ``merge`` is false.
    """
    if not callable(func):
        raise TypeError(f"expected a function of arrays, got {type(func).__name__}")

    def run(a: np.ndarray, tile: Tile) -> tuple[np.ndarray, float]:
        size = max(tile.h, tile.w)
        bottom, right = a.shape[1] - tile.top - tile.h, a.shape[2] - tile.left - tile.w
        padded = np.pad(a, [(0, 0), (depth - tile.top, depth - bottom), (depth - tile.left, depth - right)], mode=boundary)
        made = np.asarray(func(np.moveaxis(padded, 0, -1)))
        made = made[..., 0] if made.ndim == 3 else made
        if made.ndim != 2 or not np.issubdtype(made.dtype, np.integer):
            raise TypeError(f"expected whole numbers of two dimensions, found {made.dtype} of {made.ndim}")
        own = made[depth : depth + tile.h, depth : depth + tile.w].astype(np.int64)
        return own[None].astype(np.float64), float(size)

    made = bl.map_overlap(blocks, depth, run)

    def shift(batches):
        for row in bl._rows(batches):
            tile, size = bl._tile(row), int(row.size)
            across, down = -(-tile.iw // size), -(-tile.ih // size)
            own = bl._array(row).astype(np.int64)
            number = int(row.by) * across + int(row.bx)
            unique = np.where(own > 0, (own << int(across * down - 1).bit_length()) | number, 0)
            yield bl._one(row, tile, unique.astype(np.float64), 0.0)

    shifted = materialise(made.mapInPandas(shift, bl.SCHEMA), "chunks")
    return bl.merge_borders(shifted, 0, same=same) if merge else shifted


def bright_regions(chunk: np.ndarray, cut: float = 0.5) -> np.ndarray:
    """Numbers the parts of a chunk's first channel that reach ``cut``; pixels that touch at corners are together."""
    return bl.local_components(np.nan_to_num(chunk[..., 0]) >= cut, True)[0]
