"""Features of every cell of a label raster, in one table ``(label, feature, value)``.

A cell is its pixels, wherever they were read: rows meet by label, so no tile has to hold
a whole cell, and there is no margin to choose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.images import bin_of, regions
from tesserae.session import materialise

LEVELS, BINS = 32, 16
#: Shape properties and the columns of ``images.regions`` behind them; boxes end before their last number.
SHAPE: dict[str, dict[str, str]] = {
    "area": {"area": "area"},
    "centroid": {"centroid-0": "centroid_y", "centroid-1": "centroid_x"},
    "bbox": {"bbox-0": "y0", "bbox-1": "x0", "bbox-2": "y1 + 1", "bbox-3": "x1 + 1"},
    "extent": {"extent": "extent"},
    "equivalent_diameter_area": {"equivalent_diameter_area": "equivalent_diameter"},
    "axis_major_length": {"axis_major_length": "major_axis_length"},
    "axis_minor_length": {"axis_minor_length": "minor_axis_length"},
    "eccentricity": {"eccentricity": "eccentricity"},
}
GROUPS = ("morphology", "summary", "texture", "histogram")


def parse(features: Sequence[str] | str | None) -> tuple[set[str], set[str]]:
    """Groups of pixel features and single shape properties that a request names; None names all."""
    asked = list(GROUPS) if features is None else [features] if isinstance(features, str) else list(features)
    if not asked:
        raise ValueError("no features are named")
    single = {f.split(":", 1)[1] for f in asked if f.startswith("morphology:")}
    unknown = [f for f in asked if f not in GROUPS and not f.startswith("morphology:")] + sorted(single - SHAPE.keys())
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    if single and "morphology" in asked:
        raise ValueError("name the group morphology or single properties of it, not both")
    return {f for f in asked if f in GROUPS} - {"morphology"}, set(SHAPE) if "morphology" in asked else single


def place(labels: DataFrame, window: DataFrame) -> DataFrame:
    """``label, place``: whether a cell's box lies ``inside``, ``outside`` or partly (``partial``) in a one-row window ``y0, x0, y1, x1``, whose ends are not in it."""
    box = labels.where("label <> 0").groupBy("label").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r"))
    both = box.crossJoin(F.broadcast(window))
    apart = F.expr("b < y0 or a >= y1 or r < x0 or l >= x1")
    within = F.expr("a >= y0 and b < y1 and l >= x0 and r < x1")
    return both.select("label", F.when(apart, "outside").when(within, "inside").otherwise("partial").alias("place"))


def _long(wide: DataFrame, named: dict[str, Column], channel: bool) -> DataFrame:
    name = lambda n: F.concat(F.lit(f"{n}__"), F.col("c").cast("string")) if channel else F.lit(n)
    rows = F.array(*[F.struct(name(n).alias("feature"), v.cast("double").alias("value")) for n, v in named.items()])
    return wide.select("label", F.explode(rows).alias("f")).select("label", "f.feature", "f.value")


def _texture(cells: DataFrame) -> DataFrame:
    """Properties of the symmetric co-occurrence of neighbors in a row of the cell's box.

    Pixels of the box outside the cell have level 0.  Only pixels of cells are rows: pairs
    with none of them in it are what is left of the box.
    """
    level = F.when(F.col("hi") > F.col("lo"), F.bround((F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (LEVELS - 1), 0)).otherwise(0.0)
    row = Window.partitionBy("label", "c", "y").orderBy("x")
    q = cells.withColumn("q", level)
    near = q.withColumns({"after": F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("q").over(row)), "before": F.lag("x").over(row) == F.col("x") - 1})
    right = F.when(F.col("x") < F.col("x1"), F.struct(F.col("q").alias("i"), F.coalesce("after", F.lit(0.0)).alias("j")))
    left = F.when((F.col("x") > F.col("x0")) & ~F.coalesce("before", F.lit(False)), F.struct(F.lit(0.0).alias("i"), F.col("q").alias("j")))
    one = near.select("label", "c", F.explode(F.array_compact(F.array(right, left))).alias("p")).groupBy("label", "c", "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"))
    box = cells.groupBy("label", "c").agg(F.first((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0"))).alias("pairs"))
    rest = box.join(one.groupBy("label", "c").agg(F.sum("n").alias("used")), ["label", "c"], "left").select("label", "c", F.lit(0.0).alias("i"), F.lit(0.0).alias("j"), (F.col("pairs") - F.coalesce("used", F.lit(0))).alias("n"))
    every = one.unionByName(rest)
    n = every.unionByName(every.select("label", "c", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("label", "c", "i", "j").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("label", "c"))
    p = n.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.0))
    d, w = F.col("i") - F.col("j"), F.col("p")
    s = p.groupBy("label", "c").agg(
        F.sum(w * d * d).alias("contrast"), F.sum(w * F.abs(d)).alias("dissimilarity"), F.sum(w / (1 + d * d)).alias("homogeneity"), F.sum(w * w).alias("asm"),
        F.sum(w * F.col("i")).alias("m"), F.sum(w * F.col("i") * F.col("i")).alias("ii"), F.sum(w * F.col("i") * F.col("j")).alias("ij"),
    )
    var = F.col("ii") - F.col("m") * F.col("m")
    correlation = F.when(var > 1e-12, (F.col("ij") - F.col("m") * F.col("m")) / var).otherwise(1.0)
    named = {"contrast": F.col("contrast"), "dissimilarity": F.col("dissimilarity"), "homogeneity": F.col("homogeneity"), "energy": F.sqrt("asm"), "ASM": F.col("asm"), "correlation": correlation}
    return _long(s, {f"texture_{n}": v for n, v in named.items()}, True)


def cell_features(labels: DataFrame, pixels: DataFrame | None = None, features: Sequence[str] | str | None = None, drop_constant: bool = True) -> DataFrame:
    """``label, feature, value`` of every cell that lies whole in the image.

    ``labels`` is ``y, x, label`` with 0 as background, ``pixels`` is ``y, x, c, val`` and is
    needed for all but shapes.  Features of channels end in two underscores and the channel.
    A feature whose values agree to 9 digits in all cells is dropped when there are several cells.
    """
    groups, shapes = parse(features)
    if groups and pixels is None:
        raise ValueError(f"these features need pixels: {sorted(groups)}")
    own = labels.where("label <> 0").select("y", "x", "label")
    if pixels is not None:
        window = pixels.agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))
        own = own.join(place(labels, window).where("place = 'inside'").select("label"), "label", "left_semi")
    parts = []
    if shapes:
        parts.append(_long(regions(own), {n: F.expr(v) for k in SHAPE if k in shapes for n, v in SHAPE[k].items()}, False))
    if groups:
        met = own.join(pixels.select("y", "x", "c", "val"), ["y", "x"])
        w, by_cell = Window.partitionBy("label", "c"), Window.partitionBy("label")
        cells = met.withColumns({"lo": F.min("val").over(w), "hi": F.max("val").over(w)}).withColumns({k: f(c).over(by_cell) for k, f, c in (("y0", F.min, "y"), ("y1", F.max, "y"), ("x0", F.min, "x"), ("x1", F.max, "x"))})
        cells = materialise(cells, "cells")
        if "summary" in groups:
            s = cells.groupBy("label", "c").agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"), F.min("val").alias("min"), F.max("val").alias("max"))
            parts.append(_long(s, {n: F.col(n) for n in ("mean", "std", "min", "max")}, True))
        if "histogram" in groups:
            k = bin_of(F.col("val"), F.col("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1), BINS)
            h = cells.withColumn("k", k).groupBy("label", "c").agg(*[F.avg((F.col("k") == b).cast("double")).alias(f"b{b}") for b in range(BINS)])
            parts.append(_long(h, {f"histogram_bin{b}": F.col(f"b{b}") for b in range(BINS)}, True))
        if "texture" in groups:
            parts.append(_texture(cells))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not drop_constant:
        return out
    out = materialise(out, "cell-features")
    near = F.round("value", 9)
    varied = out.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), (~F.min(near).eqNullSafe(F.max(near)) | (F.count("value").between(1, F.count(F.lit(1)) - 1))).alias("varies"))
    return out.join(F.broadcast(varied.where("varies or n = 1").select("feature")), "feature", "left_semi").select("label", "feature", "value")  # a row for each feature
