"""Binary masks in blocks: discs, holes, components by area.

A disc of radius r moves over a mask by squared distances: a dilated mask is what lies
within r of it, an eroded one what lies farther than r from everything else.  Beyond
the image nothing is set and nothing is missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import blocks as bl
from tesserae.operators.segmentation import distance_transform
from tesserae.session import materialise


def _inverse(a: np.ndarray, tile: bl.Tile) -> tuple[np.ndarray, float]:
    return (~(np.nan_to_num(a[:1]) > 0)).astype(np.float64), 0.0


def invert(mask: DataFrame) -> DataFrame:
    """1 where the first plane is 0 or not there, else 0."""
    return bl.map_blocks(mask, _inverse)


def dilate(mask: DataFrame, radius: int) -> DataFrame:
    """What lies within ``radius`` of a set pixel."""
    near = distance_transform(invert(mask), max_depth=radius)
    return bl.map_blocks(near, lambda a, tile: ((a[1:2] <= radius * radius).astype(np.float64), 0.0))


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """Set pixels that lie farther than ``radius`` from all others."""
    near = distance_transform(mask, max_depth=radius)
    return bl.map_blocks(near, lambda a, tile: (((np.nan_to_num(a[:1]) > 0) & (a[1:2] > radius * radius)).astype(np.float64), 0.0))


def close(mask: DataFrame, radius: int) -> DataFrame:
    """Dilated, then eroded."""
    return erode(dilate(mask, radius), radius)


def areas(labels: DataFrame, plane: int = 0) -> DataFrame:
    """``img, value, area`` of the labels of a plane."""
    return bl.count_values(labels, plane).groupBy("img", "value").agg(F.sum("n").alias("area"))


def rename(labels: DataFrame, names: DataFrame, plane: int = 0) -> DataFrame:
    """Labels by ``names`` (``img, value, new``)."""
    there = bl.count_values(labels, plane).select(*bl.KEYS, "value")
    return bl.relabel(labels, plane, there.join(names, ["img", "value"]).select(*bl.KEYS, F.col("value").alias("old"), "new"))


def image_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("img").agg(F.max("ih").alias("h"), F.max("iw").alias("w"))


def fill_holes(mask: DataFrame, share: float) -> DataFrame:
    """Sets components of what is not set, touching by sides, of fewer pixels than a share of the image."""
    holes = materialise(bl.label_components(invert(mask)), "holes")
    small = areas(holes).join(image_sizes(holes), "img").where(F.col("area") < F.floor(F.lit(share) * F.col("h") * F.col("w")))
    return invert(rename(holes, small.select("img", "value", F.lit(0).cast("long").alias("new"))))


def clear_border(blocks: DataFrame, margins: tuple[int, int, int, int]) -> DataFrame:
    """Zeros within the margins (top, bottom, left, right); margins that would cover the image do nothing."""
    top, bottom, left, right = margins
    if not any(margins):
        return blocks

    def run(a: np.ndarray, tile: bl.Tile) -> tuple[np.ndarray, float]:
        if top + bottom >= tile.ih or left + right >= tile.iw:
            return a, 0.0
        y, x = tile.grid()
        return np.where((y >= top) & (y < tile.ih - bottom) & (x >= left) & (x < tile.iw - right), a, 0.0), 0.0

    return bl.map_blocks(blocks, run)
