"""Images as pixel rows ``(y, x, c, val)``: crops, processing and features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of red, green and blue for a gray level, by use.
LUMA = {"process": (0.2125, 0.7154, 0.0721), "qc": (0.2126, 0.7152, 0.0722), "tissue": (0.299, 0.587, 0.114)}


@dataclass(frozen=True)
class Crop:
    """A rectangle, ends included, in image coordinates."""

    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def center(self) -> tuple[float, float]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def padded(self, n: float) -> Crop:
        return Crop(self.x0 - n, self.y0 - n, self.x1 + n, self.y1 + n)


def gray(pixels: DataFrame, use: str = "process") -> DataFrame:
    """One channel: the weighted sum of three, or the mean of any other number."""
    r, g, b = LUMA[use]
    weight = F.when(F.col("c") == 0, r).when(F.col("c") == 1, g).when(F.col("c") == 2, b).otherwise(0.0)
    keys = [c for c in pixels.columns if c not in ("c", "val")]
    n = F.count_distinct("c")
    return pixels.groupBy(*keys).agg(F.when(n == 3, F.sum(F.col("val") * weight)).otherwise(F.avg("val")).alias("val"))


def crop(pixels: DataFrame, y: int, x: int, height: int, width: int, cval: float = 0.0, circle: bool = False) -> DataFrame:
    """A rectangle with its own coordinates; what lies outside the image is ``cval``."""
    inside = pixels.where(F.col("y").between(y, y + height - 1) & F.col("x").between(x, x + width - 1))
    own = inside.select((F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "c", "val")
    frame = pixels.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    grid = frame.crossJoin(pixels.select("c").distinct())  # the crop's size times the channels
    out = grid.join(own, ["y", "x", "c"], "left").withColumn("val", F.coalesce("val", F.lit(cval)))
    if circle:
        if height != width:
            raise ValueError("a circle needs a square crop")
        r = width // 2
        dy, dx = F.col("y") - r, F.col("x") - r
        out = out.withColumn("val", F.when(dy * dy + dx * dx <= r * r, F.col("val")).otherwise(F.lit(cval)))
    return out


def tiles(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Adds the tile (``ty``, ``tx``) of every pixel."""
    return pixels.withColumns({"ty": F.floor(F.col("y") / height).cast("long"), "tx": F.floor(F.col("x") / width).cast("long")})


def uncrop(parts: DataFrame) -> DataFrame:
    """Pastes crops ``(crop, oy, ox, y, x, c, val)`` at their places; later ones win."""
    at = parts.select("crop", (F.col("oy") + F.col("y")).alias("y"), (F.col("ox") + F.col("x")).alias("x"), "c", "val")
    return at.groupBy("y", "x", "c").agg(F.max_by("val", "crop").alias("val"))


def smooth(pixels: DataFrame, sigma: float = 1.0, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter, by rows and then by columns; the image is mirrored at its edges.

    Every pixel is sent to the few places that it weighs on, and weights are added up,
    so no row of the image is held as a whole.
    """
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-reach, reach + 1), weights, strict=True)])
    size = pixels.agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    out = pixels
    for axis, n in (("y", "_h"), ("x", "_w")):
        spread = out.crossJoin(F.broadcast(size)).withColumn("_k", F.explode(kernel))
        place = F.col(axis) + F.col("_k.k")
        # A mirrored pixel weighs on a place also from beyond the edge.
        targets = F.array_distinct(F.array(F.struct(place.alias("p"), F.lit(0).alias("m")), F.struct((-F.col(axis) - 1 + F.col("_k.k")).alias("p"), F.lit(1).alias("m")), F.struct((2 * F.col(n) - 1 - F.col(axis) + F.col("_k.k")).alias("p"), F.lit(2).alias("m"))))
        sent = spread.withColumn("_t", F.explode(targets)).where(F.col("_t.p").between(0, F.col(n) - 1))
        keys = [c for c in pixels.columns if c not in (axis, "val")]
        out = sent.groupBy(*keys, F.col("_t.p").alias(axis)).agg(F.sum(F.col("val") * F.col("_k.w")).alias("val")).select(*pixels.columns)
    return out


def summary(pixels: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.9, 0.5, 0.1)) -> DataFrame:
    """Quantiles, mean and population deviation of every group and channel."""
    q = [F.percentile("val", p).alias(f"quantile_{p}") for p in quantiles]
    return pixels.groupBy(*by, "c").agg(*q, F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The number of the equal-width bin; the last one is closed."""
    return F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def histogram(pixels: DataFrame, by: Sequence[str], bins: int = 10, v_range: tuple[float, float] | None = None) -> DataFrame:
    """``bin, n`` of every group and channel, over the group's own range of all channels."""
    if v_range:
        ranged = pixels.withColumns({"_lo": F.lit(float(v_range[0])), "_hi": F.lit(float(v_range[1]))})
    else:
        ranged = pixels.join(pixels.groupBy(*by).agg(F.min("val").alias("_lo"), F.max("val").alias("_hi")), list(by))
    inside = ranged.where(F.col("val").between(F.col("_lo"), F.col("_hi")))
    k = F.when(F.col("_hi") > F.col("_lo"), bin_of(F.col("val"), F.col("_lo"), F.col("_hi"), bins)).otherwise(F.lit(bins // 2))
    return inside.groupBy(*by, "c", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def texture(pixels: DataFrame, by: Sequence[str], distance: int = 1, angle: float = 0.0) -> DataFrame:
    """Properties of the symmetric co-occurrence of gray levels one step apart."""
    dy, dx = round(math.sin(angle) * distance), round(math.cos(angle) * distance)
    keys = [*by, "c"]
    a = pixels.select(*keys, "y", "x", F.col("val").alias("i"))
    b = pixels.select(*keys, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("val").alias("j"))
    one = a.join(b, [*keys, "y", "x"]).select(*keys, "i", "j")
    n = one.union(one.select(*keys, "j", "i")).groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    d = F.col("i") - F.col("j")
    s = p.groupBy(*keys).agg(
        F.sum(F.col("p") * d * d).alias("contrast"),
        F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"),
        F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"),
        F.sum(F.col("p") * F.col("p")).alias("ASM"),
        F.sum(F.col("p") * F.col("i")).alias("m"),
        F.sum(F.col("p") * F.col("i") * F.col("i")).alias("q"),
        F.sum(F.col("p") * F.col("i") * F.col("j")).alias("ij"),
    )
    var = F.col("q") - F.col("m") * F.col("m")
    return s.withColumn("correlation", F.when(var > 1e-12, (F.col("ij") - F.col("m") * F.col("m")) / var).otherwise(1.0)).drop("m", "q", "ij")


def spot_features(pixels: DataFrame, spots: DataFrame, radius: int, bins: int = 10) -> DataFrame:
    """Mean, deviation and extremes of each channel in the square around every spot.

    Pixels and spots meet by tiles as wide as a crop: a range join on equal tiles.
    """
    side = 2 * radius + 1
    t = lambda c: F.floor(F.col(c) / side)
    at = spots.select("id", F.round("x").cast("long").alias("sx"), F.round("y").cast("long").alias("sy"))
    near = at.withColumn("ty", F.explode(F.sequence(F.floor((F.col("sy") - radius) / side), F.floor((F.col("sy") + radius) / side)))).withColumn("tx", F.explode(F.sequence(F.floor((F.col("sx") - radius) / side), F.floor((F.col("sx") + radius) / side))))
    tiled = pixels.withColumns({"ty": t("y"), "tx": t("x")})
    inside = near.join(tiled, ["ty", "tx"]).where((F.abs(F.col("y") - F.col("sy")) <= radius) & (F.abs(F.col("x") - F.col("sx")) <= radius))
    return inside.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"), F.min("val").alias("min"), F.max("val").alias("max"))


def regions(labels: DataFrame) -> DataFrame:
    """Area, box, centroid and moment-based shape of every label but 0."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = labels.where("label <> 0").groupBy("label").agg(
        F.count(F.lit(1)).alias("area"),
        F.avg(y).alias("centroid_y"),
        F.avg(x).alias("centroid_x"),
        F.min("y").alias("y0"),
        F.min("x").alias("x0"),
        F.max("y").alias("y1"),
        F.max("x").alias("x1"),
        F.var_pop(y).alias("vy"),
        F.var_pop(x).alias("vx"),
        F.covar_pop(y, x).alias("vxy"),
    )
    # Second moments of pixels are those of their centers plus that of a unit square.
    a, b, c = F.col("vy") + 1 / 12, F.col("vx") + 1 / 12, F.col("vxy")
    root = F.sqrt((a - b) * (a - b) / 4 + c * c)
    big, small = (a + b) / 2 + root, (a + b) / 2 - root
    return m.select(
        "label", "area", "centroid_y", "centroid_x", "y0", "x0", "y1", "x1",
        (F.col("area") / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))).alias("extent"),
        F.sqrt(4 * F.col("area") / math.pi).alias("equivalent_diameter"),
        (4 * F.sqrt(big)).alias("major_axis_length"),
        (4 * F.sqrt(F.greatest(small, F.lit(0.0)))).alias("minor_axis_length"),
        F.sqrt(F.greatest(1 - small / big, F.lit(0.0))).alias("eccentricity"),
    )


def label_intensity(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    joined = pixels.join(labels.where("label <> 0"), ["y", "x"])
    return joined.groupBy("label", "c").agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"), F.min("val").alias("min"), F.max("val").alias("max"))


def cell_histogram(pixels: DataFrame, labels: DataFrame, bins: int = 16) -> DataFrame:
    """Shares of equal-width bins over every label's own range."""
    joined = pixels.join(labels.where("label <> 0"), ["y", "x"])
    n = histogram(joined, ["label"], bins)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label", "c"))).drop("n")


def stretch(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    low, high = F.min("val").over(w), F.max("val").over(w)
    return pixels.withColumn("val", F.when(high > low, (F.col("val") - low) / (high - low)).otherwise(1.0))


def tile_specs(cells: DataFrame, size: int) -> DataFrame:
    """The tile that owns each cell (by centroid) and the margin that crops need."""
    margin = cells.agg((F.ceil(F.max(F.greatest(F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1)) / 2) + 1).alias("margin"))
    at = cells.select("label", F.floor(F.col("centroid_y") / size).alias("ty"), F.floor(F.col("centroid_x") / size).alias("tx"))
    return at.crossJoin(F.broadcast(margin))


def otsu(values: DataFrame, bins: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """The threshold that maximises the variance between both sides: one row, or one for each group of ``by``."""
    edges = values.groupBy(*by).agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    k = bin_of(F.col("val"), F.col("lo"), F.col("hi"), bins)
    ranged = values.join(edges, list(by)) if by else values.crossJoin(F.broadcast(edges))
    n = ranged.where("hi > lo").groupBy(*by, k.alias("k"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    center = F.col("lo") + (F.col("k") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = all_.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # over the bins, not the pixels
    cum = n.withColumn("t", center).select(*by, "k", "t", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("t")).over(up).alias("s0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("t")).over(all_).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    scored = cum.where(F.col("w0") < F.col("w")).withColumn("v", F.round(F.col("w0") * w1 * gap * gap / (F.col("w") * F.col("w")), 9))
    return scored.groupBy(*by).agg(F.max_by("t", F.struct("v", -F.col("k"))).alias("threshold"))


def connected_regions(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """``y, x, label``: components of the pixels in ``mask``; the label is the least pixel number."""
    from tesserae.operators.components import connected_components

    size = mask.agg((F.max("x") + 2).alias("_w"))
    at = mask.select("y", "x").crossJoin(F.broadcast(size)).select("y", "x", (F.col("y") * F.col("_w") + F.col("x")).alias("id"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    moved = at.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    moved = moved.select(F.col("id").alias("a"), (F.col("y") + F.col("_s.i")).alias("y"), (F.col("x") + F.col("_s.j")).alias("x"))
    edges = moved.join(at.withColumnRenamed("id", "b"), ["y", "x"]).select("a", "b")
    found = connected_components(edges).withColumnsRenamed({"node": "id", "component": "label"})
    return at.join(found, "id", "left").select("y", "x", F.coalesce("label", "id").alias("label"))
