"""Microns per pixel of a coordinate system, from shapes whose spacing or size is known."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.stats import quantile
from tesserae.operators.alignment import IDENTITY, moved
from tesserae.operators.graph import knn_edges

#: Largest relative difference of the two scales of a transform, and the least share of its rectangle that a square fills.
ANISOTROPY, SQUARENESS = 1e-3, 0.98


def scales(m) -> tuple[float, float]:
    """The greater and the lesser factor by which a transform stretches lengths."""
    total = m["xx"] ** 2 + m["xy"] ** 2 + m["yx"] ** 2 + m["yy"] ** 2
    det = abs(m["xx"] * m["yy"] - m["xy"] * m["yx"])
    big = math.sqrt((total + math.sqrt(max(total * total - 4 * det * det, 0.0))) / 2)
    return big, det / big if big else 0.0


def polygon_measures(vertices: DataFrame) -> DataFrame:
    """``label, area, x, y`` of polygons ``label, ring, k, x, y``: area and its center.  The first ring is the outline, others are holes."""
    ring = Window.partitionBy("label", "ring").orderBy("k")
    first = vertices.where("x is not null and y is not null").withColumns({c: F.first(v).over(ring) for c, v in (("fx", "x"), ("fy", "y"))})
    here = first.withColumns({"u": F.col("x") - F.col("fx"), "v": F.col("y") - F.col("fy")})
    ahead = here.withColumns({"eu": F.coalesce(F.lead("u").over(ring), F.lit(0.0)), "ev": F.coalesce(F.lead("v").over(ring), F.lit(0.0))})
    cross = F.col("u") * F.col("ev") - F.col("eu") * F.col("v")
    rings = ahead.groupBy("label", "ring").agg(F.first("fx").alias("fx"), F.first("fy").alias("fy"), F.sum(cross).alias("a"), F.sum(cross * (F.col("u") + F.col("eu"))).alias("su"), F.sum(cross * (F.col("v") + F.col("ev"))).alias("sv"))
    part = F.abs(F.col("a")) / 2 * F.when(F.col("ring") == F.min("ring").over(Window.partitionBy("label")), 1.0).otherwise(-1.0)
    at = lambda f, s: F.col(f) + F.coalesce(F.try_divide(F.col(s), 3 * F.col("a")), F.lit(0.0))
    weighed = rings.select("label", part.alias("p"), at("fx", "su").alias("x"), at("fy", "sv").alias("y"))
    whole = weighed.groupBy("label").agg(F.sum("p").alias("area"), F.sum(F.col("p") * F.col("x")).alias("mx"), F.sum(F.col("p") * F.col("y")).alias("my"))
    return whole.select("label", "area", F.try_divide("mx", "area").alias("x"), F.try_divide("my", "area").alias("y"))


def rectangle_areas(vertices: DataFrame) -> DataFrame:
    """``label, box``: the least rectangle around a polygon that lies along one of its sides."""
    p = vertices.where("x is not null and y is not null").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("ring", "k", "x", "y"))).alias("p"))
    n = F.size("p")
    step = lambda i, c: F.element_at("p", (i % n + 1).cast("int"))[c] - F.element_at("p", i.cast("int"))[c]
    sides = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(step(i, "x").alias("u"), step(i, "y").alias("v"))), lambda s: (s["u"] != 0) | (s["v"] != 0))
    reach = lambda f: F.array_max(F.transform("p", f)) - F.array_min(F.transform("p", f))
    one = lambda s: reach(lambda q: q["x"] * s["u"] + q["y"] * s["v"]) * reach(lambda q: q["y"] * s["u"] - q["x"] * s["v"]) / (s["u"] * s["u"] + s["v"] * s["v"])
    return p.withColumn("sides", sides).select("label", F.array_min(F.transform("sides", one)).alias("box"))


def microns_per_pixel(shapes: DataFrame, m=None, between_centers: float | None = None, diameter: float | None = None, square_edge: float | None = None) -> float:
    """Microns per pixel of the system that transform ``m`` leads to; exactly one known length is given.

    ``shapes`` are discs ``label, x, y, radius`` or polygons ``label, ring, k, x, y``.  The length's median over
    all shapes is measured; polygons must all be nearly rectangles for ``square_edge``.  Raises where the
    transform stretches one direction more than the other, and where there is nothing to measure.
    """
    given = [v for v in (between_centers, diameter, square_edge) if v is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of between_centers, diameter and square_edge")
    m = m or IDENTITY
    big, small = scales(m)
    if not small or (big - small) / big > ANISOTROPY:
        raise ValueError(f"the transform stretches by {big:.6g} and {small:.6g}: there is no one scale")
    polygons = "k" in shapes.columns
    if diameter is not None:
        if polygons or "radius" not in shapes.columns:
            raise ValueError("diameter needs discs with a radius")
        length, factor = quantile(shapes.select((2 * F.col("radius")).alias("v")), "v", 0.5), math.sqrt(big * small)
    elif square_edge is not None:
        if not polygons:
            raise ValueError("square_edge needs polygons")
        area = polygon_measures(shapes)
        worst = area.join(rectangle_areas(shapes), "label").agg(F.min(F.try_divide("area", "box")).alias("v")).first()["v"]
        if worst is not None and worst < SQUARENESS:
            raise ValueError(f"square_edge needs rectangles; a polygon fills {worst:.4f} of its own")
        middle = quantile(area, "area", 0.5)
        length, factor = None if middle is None else math.sqrt(middle), math.sqrt(big * small)
    else:
        centers = (polygon_measures(shapes) if polygons else shapes).where("x is not null and y is not null")
        at = moved(centers.select(F.lit(0).alias("lib"), F.col("label").alias("id"), "x", "y"), m)
        length, factor = quantile(knn_edges(at, 1), "dist", 0.5), 1.0
    if not length:
        raise ValueError("there is no length to measure in these shapes")
    return given[0] / (length * factor)
