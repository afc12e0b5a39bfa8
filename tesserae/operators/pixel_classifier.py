"""A trained mask of tissue: filters at several scales, seeds from the corners, a forest, then a second look.

Corners (and margins) are seeds of background; pixels that are farthest from the corners' colors
are seeds of tissue.  A random forest learns the seeds from filter responses and says of every
pixel what it is; a logistic regression of its inside against its outside then takes back pixels
that are very likely background.

Filters run on blocks with halos, so results do not depend on the size of blocks.  Responses of
all pixels are never written: they are made anew in each of three passes (forest,
regression, mask) and go straight into the models, which Spark fits on bounded samples
(``max_seeds``, ``refine_seeds``), chosen by a hash of the pixel's place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.stats import quantile
from tesserae.operators import blocks as bl
from tesserae.session import materialise

#: A Gaussian reaches so many of its widths to each side.
REACH = 4.0


@dataclass(frozen=True)
class PixelClassifier:
    """Parameters of the filters, the seeds and the two models.

    ``max_seeds`` and ``refine_seeds`` bound about how many pixels of each class the models see.
    """

    sigma_min: float = 1.0
    sigma_max: float = 16.0
    edges: bool = True
    tissue_percentile: float = 90.0
    min_tissue: int = 50
    trees: int = 100
    max_depth: int = 10
    tree_share: float = 0.05
    max_seeds: int = 50_000
    refine: bool = True
    refine_seeds: int = 50_000
    background_limit: float = 0.6
    seed: int = 0

    def sigmas(self) -> list[float]:
        """Widths from the least to the largest, each twice the one before."""
        if not 0 < self.sigma_min <= self.sigma_max:
            raise ValueError("sigma_min is over 0 and not over sigma_max")
        return [self.sigma_min * 2**i for i in range(int(math.log2(self.sigma_max / self.sigma_min) + 1e-9) + 1)]

    def depth(self) -> int:
        """Pixels around a block that its responses depend on: the widest Gaussian and three differences."""
        return int(REACH * self.sigmas()[-1] + 0.5) + 3


def _along(a: np.ndarray, axis: int, weights: np.ndarray) -> np.ndarray:
    """Correlation with symmetric or odd weights; edge values repeat."""
    r = len(weights) // 2
    padded = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    out = np.zeros_like(a)
    for i, w in enumerate(weights):
        out += w * np.take(padded, range(i, i + a.shape[axis]), axis=axis)
    return out


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    r = int(REACH * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    return _along(_along(a, 0, weights), 1, weights)


_SLOPE, _MEAN = np.array([-0.5, 0.0, 0.5]), np.array([0.25, 0.5, 0.25])


def responses(a: np.ndarray, params: PixelClassifier) -> np.ndarray:
    """Planes of smoothed values, slopes and the two curvatures of every channel and width."""
    out = []
    for channel in np.nan_to_num(a):
        for sigma in params.sigmas():
            smooth = gaussian(channel, sigma)
            out.append(smooth)
            dy, dx = _along(smooth, 0, _SLOPE), _along(smooth, 1, _SLOPE)
            if params.edges:
                out.append(np.hypot(_along(dy, 1, _MEAN), _along(dx, 0, _MEAN)))
            yy, yx, xx = _along(dy, 0, _SLOPE), _along(dy, 1, _SLOPE), _along(dx, 1, _SLOPE)
            middle, swing = (yy + xx) / 2, np.hypot((yy - xx) / 2, yx)
            out += [middle + swing, middle - swing]
    return np.stack(out)


def place_hash(y: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for every place, always the same."""
    with np.errstate(over="ignore"):
        h = y.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
        for shift in (30, 27):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def corner_pixels(tile: bl.Tile, corners: tuple[bool, bool, bool, bool], share: float) -> np.ndarray:
    """Whether the pixels of a block lie in the chosen corners (top left, bottom left, top right, bottom right).

    Without corners a fiftieth of both sides at the top left counts.
    """
    y, x = tile.grid()
    if not any(corners):
        return (y < max(1, tile.ih // 50)) & (x < max(1, tile.iw // 50))
    ch, cw = max(1, int(share * tile.ih)), max(1, int(share * tile.iw))
    top, bottom, left, right = y < ch, y >= tile.ih - ch, x < cw, x >= tile.iw - cw
    out = np.zeros((tile.h, tile.w), bool)
    for a, b, on in ((top, left, corners[0]), (bottom, left, corners[1]), (top, right, corners[2]), (bottom, right, corners[3])):
        if on:
            out |= a & b
    return out


def _inner(tile: bl.Tile, margins: tuple[int, int, int, int]) -> np.ndarray:
    y, x = tile.grid()
    top, bottom, left, right = margins
    return (y >= top) & (y < tile.ih - bottom) & (x >= left) & (x < tile.iw - right)


def background_colors(blocks: DataFrame, corners: tuple[bool, bool, bool, bool], share: float) -> list[tuple[float, float]]:
    """Mean and deviation of every channel in the corners, from sums of blocks."""

    def sums(canvas: np.ndarray, tile: bl.Tile) -> pd.DataFrame:
        there = tile.inner(canvas)[:, corner_pixels(tile, corners, share)]
        v = np.nan_to_num(there)
        return pd.DataFrame({"c": np.arange(len(v)), "n": (~np.isnan(there)).sum(1).astype(float), "s": v.sum(1), "q": (v * v).sum(1)})

    found = bl.overlap_rows(blocks, 0, sums, "c int, n double, s double, q double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    out = []
    for row in found.orderBy("c").collect():  # a row for each channel
        mean = row["s"] / row["n"] if row["n"] else 0.0
        out.append((mean, max(math.sqrt(max(row["q"] / row["n"] - mean * mean, 0.0)) if row["n"] else 0.0, 1e-6)))
    return out


def _far(a: np.ndarray, colors: list[tuple[float, float]]) -> np.ndarray:
    """How many deviations a pixel is from the corners' colors, over all channels."""
    return np.sqrt(sum(((np.nan_to_num(plane) - mean) / deviation) ** 2 for plane, (mean, deviation) in zip(a, colors, strict=True)))


_ROWS = "img string, y long, x long, seed int, features array<double>"


def tissue_mask(blocks: DataFrame, params: PixelClassifier = PixelClassifier(), corners: tuple[bool, bool, bool, bool] = (True,) * 4, share: float = 0.01, margins: tuple[int, int, int, int] = (0, 0, 0, 0), size: int = bl.SIZE) -> DataFrame | None:
    """Blocks of one plane, 1 where the one image of ``blocks`` shows tissue; None if no pixel can be a seed of tissue.

    That is so for an empty table, an image of one color and one that its corners and margins cover.
    """
    colors = background_colors(blocks, corners, share)
    if not colors:
        return None

    def distance(a: np.ndarray, tile: bl.Tile) -> tuple[np.ndarray, float]:
        free = _inner(tile, margins) & ~corner_pixels(tile, corners, share)
        return np.where(free, _far(a, colors), np.nan)[None], 0.0

    far = materialise(bl.to_pixels(bl.map_blocks(blocks, distance), 0).select("val"), "distance")
    some = far.agg(F.max("val").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not some["n"] or not some["most"]:
        return None
    limit = quantile(far, "val", min(max(params.tissue_percentile, 0.0), 100.0) / 100)
    n_tissue = far.where(F.col("val") >= limit).count()
    if n_tissue < params.min_tissue:  # the farthest pixels, with all that tie with the last of them
        limit = far.orderBy(F.desc("val")).limit(params.min_tissue).agg(F.min("val")).first()[0]
        n_tissue = far.where(F.col("val") >= limit).count()

    def classes(a: np.ndarray, tile: bl.Tile) -> np.ndarray:
        """2 for seeds of tissue, 1 for seeds of background, else 0."""
        corner, inner = corner_pixels(tile, corners, share), _inner(tile, margins)
        return np.where(corner | ~inner, 1, np.where(_far(a, colors) >= limit, 2, 0))

    def background(a: np.ndarray, tile: bl.Tile) -> tuple[np.ndarray, float]:
        return a[:1], float((classes(a, tile) == 1).sum())

    n_background = bl.map_blocks(blocks, background).agg(F.sum("stat")).first()[0]
    rates = {1: min(1.0, params.max_seeds / max(n_background, 1.0)), 2: min(1.0, params.max_seeds / max(n_tissue, 1))}

    def rows(seeds_only: bool) -> DataFrame:
        def make(canvas: np.ndarray, tile: bl.Tile) -> pd.DataFrame:
            own = tile.inner(canvas)
            kind, drawn = classes(own, tile), place_hash(*np.broadcast_arrays(*tile.grid()), params.seed)
            wanted = np.ones(kind.shape, bool)
            if seeds_only:
                wanted = ((kind == 1) & (drawn < rates[1])) | ((kind == 2) & (drawn < rates[2]))
            if not wanted.any():
                return pd.DataFrame({"img": [], "y": [], "x": [], "seed": [], "features": []})
            found = tile.inner(responses(canvas, params))[:, wanted].T
            y, x = np.nonzero(wanted)
            return pd.DataFrame({"img": tile.img, "y": y + tile.y0, "x": x + tile.x0, "seed": kind[wanted].astype(np.int32), "features": list(found)})

        made = bl.overlap_rows(blocks, params.depth(), make, _ROWS)
        return made.select("img", "y", "x", "seed", array_to_vector("features").alias("features"))

    def fitted(estimator, sample: DataFrame):
        # Partitions and their order are fixed by places, since both decide what trees draw.
        kept = sample.repartition(8, "y", "x").sortWithinPartitions("y", "x").persist()
        model = estimator.fit(kept)
        kept.unpersist()
        return model

    forest = RandomForestClassifier(featuresCol="features", labelCol="label", predictionCol="forest", rawPredictionCol="votes", probabilityCol="shares", numTrees=params.trees, maxDepth=params.max_depth, subsamplingRate=params.tree_share, seed=params.seed)
    told = fitted(forest, rows(True).withColumn("label", (F.col("seed") == 2).cast("double"))).transform(rows(False))
    top, bottom, left, right = margins
    size_of = blocks.select("ih", "iw").first()
    inside = (F.col("y") >= top) & (F.col("y") < size_of["ih"] - bottom) & (F.col("x") >= left) & (F.col("x") < size_of["iw"] - right)
    told = told.select("img", "y", "x", "features", ((F.col("forest") == 1) & inside).alias("prior"))
    mask = F.col("prior")
    if params.refine:
        many = {r["prior"]: r["count"] for r in told.groupBy("prior").count().collect()}  # two rows at most
        if len(many) == 2:
            drawn = F.pmod(F.xxhash64("y", "x", F.lit(params.seed)), F.lit(1 << 30)) / float(1 << 30)
            rate = F.when(mask, F.lit(min(1.0, params.refine_seeds / many[True]))).otherwise(F.lit(min(1.0, params.refine_seeds / many[False])))
            sample = told.where(drawn < rate).withColumn("label", (~mask).cast("double"))
            # The usual penalty of one unit against the sum of losses.
            penalty = 1.0 / sum(min(n, params.refine_seeds) for n in many.values())
            second = LogisticRegression(featuresCol="features", labelCol="label", predictionCol="second", rawPredictionCol="margin", probabilityCol="chance", regParam=penalty, maxIter=1000)
            told = fitted(second, sample).transform(told)
            mask = mask & (vector_to_array("chance")[1] < params.background_limit)
    return bl.to_blocks(told.select("img", "y", "x", F.lit(0).alias("c"), mask.cast("double").alias("val")), size)
