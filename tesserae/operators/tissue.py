"""Where the tissue of a slide is: a threshold, then a mask made solid, sorted by size and smoothed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.stats import quantile
from tesserae.operators import blocks as bl
from tesserae.operators import morphology as mo
from tesserae.operators.images import gray, otsu
from tesserae.operators.pixel_classifier import PixelClassifier, tissue_mask
from tesserae.operators.segmentation import number_labels
from tesserae.session import materialise


@dataclass(frozen=True)
class Corners:
    """Which corners are background, and their size as a share of the image's sides."""

    top_left: bool = True
    bottom_left: bool = True
    top_right: bool = True
    bottom_right: bool = True
    share: float = 0.01


def margins_of(margin: int | Sequence[int], height: int, width: int) -> tuple[int, int, int, int]:
    """Top, bottom, left and right; all 0 where they would cover the image."""
    if isinstance(margin, (str, bytes)):
        raise TypeError("a margin is a number or four numbers")
    four = [int(v) for v in margin] if isinstance(margin, Sequence) else [int(margin)] * 4
    if len(four) != 4 or min(four) < 0:
        raise ValueError("a margin is a number or four numbers (top, bottom, left, right), none negative")
    top, bottom, left, right = four
    return (0, 0, 0, 0) if top + bottom >= height or left + right >= width else (top, bottom, left, right)


def scaled_margins(margins: tuple[int, int, int, int], old: tuple[int, int], new: tuple[int, int]) -> tuple[int, int, int, int]:
    """Margins of an image for the same image at another size."""
    if not all(old):
        return (0, 0, 0, 0)
    top, bottom, left, right = (round(m * b / a) for m, a, b in zip(margins, (old[0], old[0], old[1], old[1]), (new[0], new[0], new[1], new[1]), strict=True))
    return (0, 0, 0, 0) if top + bottom >= new[0] or left + right >= new[1] else (top, bottom, left, right)


def coarse(level: DataFrame, height: int, width: int, most: int) -> tuple[DataFrame, int, int]:
    """Means of equal windows, so that at most about ``most`` pixels remain; an incomplete last window goes."""
    if height * width <= most:
        return level, height, width
    scale = math.sqrt(most / (height * width))
    fy, fx = (math.ceil(n / max(1, int(n * scale))) for n in (height, width))
    h, w = height // fy, width // fx
    kept = level.where((F.col("y") < h * fy) & (F.col("x") < w * fx))
    channel = [c for c in ("c",) if c in level.columns]
    return kept.groupBy(F.floor(F.col("y") / fy).cast("long").alias("y"), F.floor(F.col("x") / fx).cast("long").alias("x"), *channel).agg(F.avg("val").alias("val")), h, w


def background_is_bright(level: DataFrame, height: int, width: int, corners: Corners) -> bool:
    """Whether the mean of the corners reaches the median; true without corners."""
    ch, cw = max(1, int(corners.share * height)), max(1, int(corners.share * width))
    top, bottom, left, right = F.col("y") < ch, F.col("y") >= height - ch, F.col("x") < cw, F.col("x") >= width - cw
    asked = [a & b for a, b, on in ((top, left, corners.top_left), (bottom, left, corners.bottom_left), (top, right, corners.top_right), (bottom, right, corners.bottom_right)) if on]
    if not asked:
        return True
    inside = asked[0]
    for one in asked[1:]:
        inside = inside | one
    mean = level.where(inside).agg(F.avg("val")).first()[0]
    return mean is None or mean >= quantile(level, "val", 0.5)


def specimens(labels: DataFrame, min_share: float, n_samples: int | None = None) -> DataFrame:
    """Components large enough to be specimens, numbered from 1.

    At least ``min_share`` of the image; then the ``n_samples`` largest, numbered by size (of equal ones
    the first), or those over Otsu's threshold of the logarithms of areas, numbered in order.
    One component alone stays; several of equal size are all at the threshold and go.
    """
    found = materialise(mo.areas(labels).join(mo.image_sizes(labels), "img"), "areas")
    large = found.where(F.col("area") >= F.greatest(F.floor(F.lit(min_share) * F.col("h") * F.col("w")), F.lit(1)))
    if n_samples is not None:
        place = F.row_number().over(Window.partitionBy("img").orderBy(F.col("area").desc(), "value"))  # a row for each large component
        kept = large.withColumn("new", place.cast("long")).where(F.col("new") <= n_samples).select("img", "value", "new")
        gone = found.join(kept, ["img", "value"], "left_anti").select("img", "value", F.lit(0).cast("long").alias("new"))
        return mo.rename(labels, kept.unionByName(gone))
    size = large.withColumn("val", F.log10(F.col("area") + 1e-9))
    cut = size.groupBy("img").agg(F.count(F.lit(1)).alias("many")).join(otsu(size.select("img", "val"), by=["img"]), "img", "left")
    kept = size.join(cut, "img").where((F.col("many") == 1) | (F.col("val") > F.col("threshold"))).select("img", "value")
    gone = found.join(kept, ["img", "value"], "left_anti").select("img", "value", F.lit(0).cast("long").alias("new"))
    return number_labels(mo.rename(labels, gone), 0)


def smoothed(labels: DataFrame, cycles: int, height: int, width: int) -> DataFrame:
    """Closes the mask with growing discs and numbers its components anew."""
    if cycles <= 0:
        return labels
    mask, first = labels, max(1, min(5, min(height, width) // 100))
    for i in range(cycles):
        mask = mo.close(mask, first + i)
    return number_labels(bl.label_components(mask, 0, diagonal=True), 0)


def detect_tissue(
    pixels: DataFrame,
    corners: Corners = Corners(),
    border_margin: int | Sequence[int] = 0,
    min_specimen_share: float = 0.01,
    n_samples: int | None = None,
    max_pixels: int = 5_000_000,
    hole_share: float = 0.0001,
    smoothing_cycles: int = 0,
    size: int = bl.SIZE,
    classifier: PixelClassifier | None = None,
) -> DataFrame:
    """``y, x, label`` of the tissue in an image of pixel rows ``y, x, c, val``.

    Otsu's threshold on gray levels, on the side that the corners are not on, or what a
    ``classifier`` learns from the corners; margins cleared, small holes filled, specimens kept, the mask smoothed and, if it
    was made on means of windows, brought back to the size of the image.  An image without
    pixels or of one level has no tissue.
    """
    shape = pixels.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).first()
    empty = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.lit(0).cast("long").alias("label")).limit(0)
    if shape["h"] is None:
        return empty
    full = margins_of(border_margin, shape["h"], shape["w"])
    if classifier is not None:
        return _classified(pixels, classifier, corners, full, (shape["h"], shape["w"]), max_pixels, hole_share, min_specimen_share, n_samples, smoothing_cycles, size, empty)
    level, h, w = coarse(gray(pixels, "tissue"), shape["h"], shape["w"], max_pixels)
    level = materialise(level.select(F.lit("image").alias("img"), "y", "x", F.lit(0).alias("c"), "val"), "level")
    threshold = otsu(level.select("val")).first()["threshold"]
    if threshold is None:
        return empty
    bright = background_is_bright(level, h, w, corners)
    margins = scaled_margins(full, (shape["h"], shape["w"]), (h, w))
    mask = bl.map_blocks(bl.to_blocks(level, size), lambda a, tile: (((a <= threshold) if bright else (a >= threshold)).astype(np.float64), 0.0))
    return _finished(mask, margins, (h, w), (shape["h"], shape["w"]), hole_share, min_specimen_share, n_samples, smoothing_cycles)


def _classified(pixels, classifier, corners, margins, shape, max_pixels, hole_share, min_specimen_share, n_samples, smoothing_cycles, size, empty) -> DataFrame:
    level, h, w = coarse(pixels.select("y", "x", "c", "val"), *shape, max_pixels)
    blocks = materialise(bl.to_blocks(level, size), "level")
    inner = scaled_margins(margins, shape, (h, w))
    mask = tissue_mask(blocks, classifier, (corners.top_left, corners.bottom_left, corners.top_right, corners.bottom_right), corners.share, inner, size)
    return empty if mask is None else _finished(mask, inner, (h, w), shape, hole_share, min_specimen_share, n_samples, smoothing_cycles)


def _finished(mask: DataFrame, margins: tuple[int, int, int, int], made: tuple[int, int], shape: tuple[int, int], hole_share: float, min_specimen_share: float, n_samples: int | None, smoothing_cycles: int) -> DataFrame:
    """Numbered specimens of a mask, at the size of the image."""
    mask = mo.clear_border(mask, margins)
    if hole_share > 0:
        mask = mo.fill_holes(materialise(mask, "mask"), hole_share)
    found = materialise(bl.label_components(materialise(mask, "mask"), 0, diagonal=True), "tissue")
    labels = mo.clear_border(smoothed(specimens(found, min_specimen_share, n_samples), smoothing_cycles, *made), margins)
    if made != shape:
        labels = bl.resize_nearest(labels, mask.sparkSession.createDataFrame([("image", *shape)], "img string, h long, w long"))
    return bl.to_pixels(labels, 0, above=0.0).select("y", "x", F.col("val").cast("long").alias("label"))
