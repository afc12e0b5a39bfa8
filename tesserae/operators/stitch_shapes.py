"""Which pieces of cut cells belong together, judged by the shape that they make.

Facing straight sides give candidates; what their places tell bounds the score, and only
pairs that can still reach the asked confidence have their pixels fetched.  The two pieces of a pair
meet in one task, where the seam is closed; all measures of the closed shapes are grouped sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.components import connected_components
from tesserae.operators.outline import hulls, perimeters
from tesserae.operators.qc import straight_sides
from tesserae.session import materialise

#: Parts of a score; the last two need pixels and are at most 1.
PLACED, SHAPED = ("iou", "endpoint_match", "gap_proximity"), ("merge_solidity", "merge_compactness")


@dataclass(frozen=True)
class Stitching:
    """How pieces are matched; sides are at least ``min_run`` pixels long and that share of the piece's diameter."""

    max_gap: float = 3.0
    min_iou: float = 0.2
    min_run: int = 5
    min_run_ratio: float = 0.4
    close_radius: int = 3
    min_confidence: float = 0.7
    max_size: int = 4

    def __post_init__(self) -> None:
        if min(self.max_gap, self.min_run, self.close_radius) < 0 or self.max_size < 1:
            raise ValueError("gaps, runs and radii are not negative, and a group has a piece at least")
        if not all(0 <= v <= 1 for v in (self.min_iou, self.min_run_ratio, self.min_confidence)):
            raise ValueError("shares and confidences lie between 0 and 1")


def candidate_pairs(labels: DataFrame, how: Stitching) -> DataFrame:
    """``axis, a, b``, both sides' places and ends, and the parts of the score that need no pixels.

    Axis ``h`` is a seam along a row.  Sides meet by buckets as wide as the largest gap, so a side meets those of its own seam only.
    """
    area = labels.where("label <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("area"))
    long = F.greatest(F.lit(float(how.min_run)), how.min_run_ratio * F.sqrt(4 * F.col("area") / math.pi))
    sides = straight_sides(labels).join(area, "label").where(F.col("run") >= long)
    width = int(how.max_gap) + 1
    axis = F.when(F.col("side").isin("top", "bottom"), "h").otherwise("v")
    named = lambda p: [F.col("label").alias(p), F.col("at").alias("at_" + p), F.col("start").alias("lo_" + p), F.col("stop").alias("hi_" + p), F.col("run").alias("run_" + p)]
    bucket = F.floor(F.col("at") / width)
    out = sides.where(F.col("side").isin("bottom", "right")).select(axis.alias("axis"), *named("p"), F.explode(F.array(bucket, bucket + 1)).alias("k"))
    into = sides.where(F.col("side").isin("top", "left")).select(axis.alias("axis"), *named("q"), bucket.alias("k"))
    shared = F.least("hi_p", "hi_q") - F.greatest("lo_p", "lo_q") + 1
    gap = F.col("at_q") - F.col("at_p") - 1
    apart = F.abs(F.col("lo_p") - F.col("lo_q")) + F.abs(F.col("hi_p") - F.col("hi_q"))
    near = (1 - gap / (2.0 * how.close_radius)) if how.close_radius else F.lit(1.0)
    met = out.join(into, ["axis", "k"]).drop("k").where((F.col("p") != F.col("q")) & (gap >= 0) & (gap <= how.max_gap) & (shared > 0))
    met = met.withColumns({"iou": shared / (F.col("run_p") + F.col("run_q") - shared), "endpoint_match": F.greatest(F.lit(0.0), 1 - apart / F.greatest("run_p", "run_q")), "gap_proximity": F.greatest(F.lit(0.0), near)})
    return met.where(F.col("iou") >= how.min_iou).withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")})


def closed(points: np.ndarray, radius: int) -> np.ndarray:
    """The largest part (pixels touch at corners too, the first of equal ones) of pixels ``(n, 2)`` after closing by a disc."""
    low = points.min(0) - 2 * radius - 1
    mask = np.zeros(points.max(0) - low + 2 * radius + 2, bool)
    mask[tuple((points - low).T)] = True
    disc = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    grown, kept = np.zeros_like(mask), np.ones_like(mask)
    for i, j in disc:  # the margin is wide enough for the edges not to matter
        grown |= np.roll(mask, (i, j), (0, 1))
    for i, j in disc:
        kept &= np.roll(grown, (i, j), (0, 1))
    left = dict.fromkeys(map(tuple, np.argwhere(kept).tolist()))
    best: list[tuple[int, int]] = []
    while left:
        part = [next(iter(left))]
        del left[part[0]]
        for y, x in part:
            for near in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if near in left:
                    del left[near]
                    part.append(near)
        best = part if len(part) > len(best) else best
    return np.array(best).reshape(-1, 2) + low


def merged_shapes(labels: DataFrame, pairs: DataFrame, radius: int) -> DataFrame:
    """``pair, merge_solidity, merge_compactness`` of the closed union of labels ``a`` and ``b`` of each ``pair`` (a number from 1)."""
    ends = pairs.select("pair", F.explode(F.array("a", "b")).alias("label"))
    pixels = labels.where("label <> 0").join(ends, "label").select("pair", "y", "x")

    def close(part: pd.DataFrame) -> pd.DataFrame:
        made = closed(part[["y", "x"]].to_numpy(np.int64), radius)
        return pd.DataFrame({"label": np.full(len(made), part["pair"].iloc[0]), "y": made[:, 0], "x": made[:, 1]})

    shapes = materialise(pixels.groupBy("pair").applyInPandas(close, "label long, y long, x long"), "closed")
    both = hulls(shapes).join(perimeters(shapes), "label")
    round_ = 4 * math.pi * F.col("area") / F.pow(F.greatest("perimeter", F.lit(1.0)), 2)
    return both.select(F.col("label").alias("pair"), F.least("solidity", F.lit(1.0)).alias("merge_solidity"), F.least(round_, F.lit(1.0)).alias("merge_compactness"))


def scored_pairs(labels: DataFrame, how: Stitching) -> DataFrame:
    """Candidate pairs with all parts of their score and ``confidence``, their mean; the best of each pair and axis, from ``min_confidence``."""
    bound = (sum((F.col(c) for c in PLACED), F.lit(0.0)) + len(SHAPED)) / (len(PLACED) + len(SHAPED))
    hopeful = materialise(candidate_pairs(labels, how).where(bound >= how.min_confidence), "hopeful")
    numbered = materialise(hopeful.select("a", "b").distinct().withColumn("pair", F.monotonically_increasing_id() + 1), "pairs")
    shaped = hopeful.join(numbered, ["a", "b"]).join(merged_shapes(labels, numbered, how.close_radius), "pair").drop("pair")
    scored = shaped.withColumn("confidence", sum((F.col(c) for c in (*PLACED, *SHAPED)), F.lit(0.0)) / (len(PLACED) + len(SHAPED))).where(F.col("confidence") >= how.min_confidence)
    best = Window.partitionBy("a", "b", "axis").orderBy(F.col("confidence").desc(), "at_p", "lo_p")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def plausible(pairs: DataFrame, sized: DataFrame, max_gap: float) -> DataFrame:
    """``group_id`` of groups whose seams can come from one cell.

    Three pieces or more along one axis need seams that lie further apart than ``max_gap``; of four pieces that
    meet along both axes every side must end near the crossing, the mean of all sides' places.
    ``pairs`` has ``group_id``; ``sized`` is ``group_id, n_pieces``.
    """
    seam = (F.col("at_p") + F.col("at_q")) / 2
    along = Window.partitionBy("group_id", "axis").orderBy("seam")
    seams = pairs.withColumn("seam", seam).withColumn("step", F.col("seam") - F.lag("seam").over(along))
    facts = seams.groupBy("group_id").agg(
        F.avg(F.when(F.col("axis") == "h", F.col("seam"))).alias("jy"), F.avg(F.when(F.col("axis") == "v", F.col("seam"))).alias("jx"), F.min("step").alias("step"),
    )
    chain = F.col("jy").isNull() | F.col("jx").isNull()
    known = pairs.join(facts, "group_id").join(sized, "group_id")
    to = F.when(F.col("axis") == "h", F.col("jx")).otherwise(F.col("jy"))
    # A side's outline ends half a pixel beyond its last pixels.
    off = lambda p: F.least(F.abs(F.col("lo_" + p) - 0.5 - to), F.abs(F.col("hi_" + p) + 0.5 - to))
    good = F.when(F.col("n_pieces") < 3, True).when(chain, F.coalesce(F.col("step") > max_gap, F.lit(True))).when(F.col("n_pieces") != 4, True).otherwise(F.greatest(off("p"), off("q")) <= max_gap)
    return known.groupBy("group_id").agg(F.min(good).alias("good")).where("good").select("group_id")


def stitch_by_shape(labels: DataFrame, how: Stitching | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``label, group_id, n_pieces, confidence`` of all labels; a group is named after its least label.

    ``candidates`` (``label``), such as the outliers of ``qc.tiling_qc``, are the only ones that may join.  Groups of
    too many pieces, or with seams that one cell can't have, fall apart.  ``confidence`` is a group's weakest pair, null alone.
    """
    how = how or Stitching()
    own = labels if candidates is None else labels.join(candidates.select("label").distinct(), "label", "left_semi")
    pairs = materialise(scored_pairs(own, how), "scored")
    found = materialise(connected_components(pairs.select("a", "b")).withColumnsRenamed({"node": "label", "component": "group_id"}), "groups")
    sized = found.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_pieces")).where(F.col("n_pieces") <= how.max_size)
    inside = pairs.join(found.withColumnRenamed("label", "a"), "a").join(sized.select("group_id"), "group_id", "left_semi")
    kept = sized.join(plausible(inside, sized, how.max_gap), "group_id", "left_semi").join(inside.groupBy("group_id").agg(F.min("confidence").alias("confidence")), "group_id")
    every = labels.where("label <> 0").select("label").distinct().join(found.join(kept, "group_id"), "label", "left")
    return every.select("label", F.coalesce("group_id", "label").alias("group_id"), F.coalesce("n_pieces", F.lit(1)).alias("n_pieces"), "confidence")
