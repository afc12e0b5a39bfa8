"""Distance joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ("lib",)) -> DataFrame:
    """Pairs within ``radius`` (inclusive), with columns of both sides as ``a_*`` and ``b_*`` and ``d2``.

    Both sides have x, y and the key columns.  Cells are as wide as the radius; each left
    row visits the nine cells around it, so each pair meets in one cell.  Both sides grow with
    the cells, however small their files are, so neither is ever broadcast through the driver.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    a = left.select(*[F.col(c).alias(f"a_{c}" if c not in keys else c) for c in left.columns], cell("x").alias("_cx"), cell("y").alias("_cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = a.withColumn("_o", F.explode(around)).withColumns({"_gx": F.col("_cx") + F.col("_o.i"), "_gy": F.col("_cy") + F.col("_o.j")}).drop("_o", "_cx", "_cy")
    b = right.select(*[F.col(c).alias(f"b_{c}" if c not in keys else c) for c in right.columns], cell("x").alias("_gx"), cell("y").alias("_gy"))
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    joined = a.join(b.hint("merge"), [*keys, "_gx", "_gy"]).withColumn("d2", dx * dx + dy * dy)
    return joined.where(F.col("d2") <= F.lit(float(radius) * float(radius))).drop("_gx", "_gy")
