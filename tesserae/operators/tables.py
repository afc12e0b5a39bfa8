"""Windows over cells and distances to anchors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.graph import knn_edges


def default_window_size(points: DataFrame) -> int:
    row = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    return max(int(math.floor(max(row["w"] or 0, row["h"] or 0) // 3.95)), 1)


def window_corners(points: DataFrame, size: float, overlap: float = 0, drop_partial: bool = False) -> DataFrame:
    """``lib, window_id, x0, x1, y0, y1``: a grid of square windows over every library, by columns."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    box = points.groupBy("lib").agg(F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
    n = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / step), F.lit(1)).cast("int")
    grid = box.withColumn("i", F.explode(F.sequence(F.lit(0), n("xa", "xb") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), n("ya", "yb") - 1)))
    x0, y0 = F.col("xa") + F.col("i") * step, F.col("ya") + F.col("j") * step
    x1, y1 = x0 + size, y0 + size
    if drop_partial:
        grid = grid.where((x1 <= F.col("xb")) & (y1 <= F.col("yb")))
    else:
        x1, y1 = F.least(x1, F.col("xb")), F.least(y1, F.col("yb"))
    number = F.row_number().over(Window.partitionBy("lib").orderBy("i", "j")) - 1
    return grid.select("lib", number.cast("long").alias("window_id"), "i", "j", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


def sliding_window(points: DataFrame, size: float | None = None, overlap: float = 0, drop_partial: bool = False) -> DataFrame:
    """``lib, id, window_id``: windows, closed on all sides, that hold each cell.

    Without overlap a cell on a shared edge belongs to the later window only.  A cell
    looks up the few grid places whose windows can reach it.
    """
    size = size or default_window_size(points)
    step = size - overlap
    corners = window_corners(points, size, overlap, drop_partial)
    box = points.groupBy("lib").agg(F.min("x").alias("xa"), F.min("y").alias("ya"))
    back = math.ceil(size / step)
    at = points.select("lib", "id", "x", "y").join(box, "lib")
    place = lambda c, a: F.floor((F.col(c) - F.col(a)) / step)
    around = lambda c, a: F.explode(F.sequence(F.greatest(place(c, a) - back, F.lit(0)).cast("int"), place(c, a).cast("int")))
    seen = at.withColumn("i", around("x", "xa")).withColumn("j", around("y", "ya")).join(corners, ["lib", "i", "j"])
    inside = seen.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    if overlap == 0:
        return inside.groupBy("lib", "id").agg(F.max("window_id").alias("window_id"))
    return inside.select("lib", "id", "window_id")


def var_by_distance(points: DataFrame, groups: Sequence[str], value: str = "cl", covariates: Sequence[str] = ()) -> DataFrame:
    """``lib, id, anchor, dist_raw, dist_norm`` to the nearest cell of every anchor group in the library.

    Normalised: zeros are absent but for one cell at the smallest distance, which is 0,
    and the largest is 1.
    """
    p = points.where(~F.isnan("x") & ~F.isnan("y"))
    out = None
    for group in groups:
        # A cell may be its own anchor, so anchors get ids of their own.
        anchors = p.where(F.col(value) == group).select("lib", (-1 - F.col("id")).alias("id"), "x", "y")
        near = knn_edges(anchors, 1, queries=p.select("lib", "id", "x", "y"))
        rows = near.select("lib", F.col("src").alias("id"), F.lit(group).alias("anchor"), F.col("dist").alias("dist_raw"))
        out = rows if out is None else out.unionByName(rows)
    per = Window.partitionBy("lib", "anchor")
    positive = F.when(F.col("dist_raw") > 0, F.col("dist_raw"))
    first = F.row_number().over(per.orderBy(positive.isNull(), positive, "id")) == 1
    norm = F.when(first & (positive == F.min(positive).over(per)), F.lit(0.0)).otherwise(positive)
    scaled = out.withColumn("_n", norm).withColumn("dist_norm", F.col("_n") / F.max("_n").over(per)).drop("_n")
    return scaled.join(points.select("lib", "id", *covariates), ["lib", "id"]) if covariates else scaled


def distance_regression(design: DataFrame, target: str, order: int = 5, by: Sequence[str] = ("anchor",)) -> DataFrame:
    """Sums of powers of the distance and of the target times them: the normal equations of a polynomial fit."""
    d = F.col("dist_norm")
    powers = [F.sum(F.pow(d, F.lit(k))).alias(f"s{k}") for k in range(2 * order + 1)]
    mixed = [F.sum(F.pow(d, F.lit(k)) * F.col(target)).alias(f"t{k}") for k in range(order + 1)]
    return design.where(d.isNotNull() & F.col(target).isNotNull()).groupBy(*by).agg(*powers, *mixed)
