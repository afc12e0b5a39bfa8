"""Elements on different grids: transforms as rows, labels and shapes brought onto an image's pixels.

A transform is a row ``element, system, xx, xy, xo, yx, yy, yo``: it takes ``(x, y)`` of the
element to ``(xx x + xy y + xo, yx x + yy y + yo)`` of the system.  Pixel ``(y, x)`` is the
square from there to the next whole numbers; it belongs to what holds its middle.
Shapes become spans, rows ``label, y, x0, x1`` with ``x1`` outside, so that work grows with
their height and not with their area until pixels are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tesserae.operators.cell_features import place

MATRIX = ("xx", "xy", "xo", "yx", "yy", "yo")
IDENTITY = {"xx": 1.0, "xy": 0.0, "xo": 0.0, "yx": 0.0, "yy": 1.0, "yo": 0.0}
#: Pixels of a row that a span meets at once in a join.
STRIP = 64


def relative(transforms: DataFrame, pairs: DataFrame, atol: float = 1e-6) -> DataFrame:
    """For each pair ``image, labels`` the transform from the labels' pixels to the image's.

    The system is ``global`` where both have it, else the first of those they share; it is
    null where they share none.  ``tx, ty`` are whole pixels where the transform is nothing but
    such a shift, else null, as is the matrix where the image's own can't be inverted.
    """
    side = lambda name, p: transforms.select(F.col("element").alias(name), "system", *[F.col(c).cast("double").alias(p + c) for c in MATRIX])
    both = pairs.select("image", "labels").join(side("image", "i"), "image").join(side("labels", "l"), ["labels", "system"])
    order = F.struct(F.col("system") != "global", F.col("system"))
    one = both.groupBy("image", "labels").agg(F.min_by(F.struct("system", *[p + c for p in "il" for c in MATRIX]), order).alias("m")).select("image", "labels", "m.*")
    by_x = lambda v: f"(iyy * ({v[0]}) - ixy * ({v[1]})) / nullif(ixx * iyy - ixy * iyx, 0)"
    by_y = lambda v: f"(ixx * ({v[1]}) - iyx * ({v[0]})) / nullif(ixx * iyy - ixy * iyx, 0)"
    parts = {"x": ("lxx", "lyx"), "y": ("lxy", "lyy"), "o": ("lxo - ixo", "lyo - iyo")}
    made = one.select("image", "labels", "system", *[F.expr(f(parts[k])).alias(r + k) for r, f in (("x", by_x), ("y", by_y)) for k in "xyo"])
    near = lambda c, to, tol: F.abs(F.col(c) - to) <= tol
    still = near("xx", 1, atol + 1e-5) & near("yy", 1, atol + 1e-5) & near("xy", 0, atol) & near("yx", 0, atol)
    whole = still & (F.abs(F.col("xo") - F.round("xo")) < atol) & (F.abs(F.col("yo") - F.round("yo")) < atol)
    made = made.withColumns({"tx": F.when(whole, F.round("xo").cast("long")), "ty": F.when(whole, F.round("yo").cast("long"))})
    return pairs.select("image", "labels").join(made, ["image", "labels"], "left")


def between(transforms: DataFrame, image: str, labels: str) -> Row:
    """The one row of ``relative`` for two elements; raises where there is none."""
    pair = transforms.limit(1).select(F.lit(image).alias("image"), F.lit(labels).alias("labels"))
    row = relative(transforms, pair).first()
    if row is None or row["system"] is None:
        raise ValueError(f"{image} and {labels} share no coordinate system")
    if row["xx"] is None:
        raise ValueError(f"the transform of {image} can't be inverted")
    return row


def _inverse(m) -> tuple[float, float, float, float]:
    det = m["xx"] * m["yy"] - m["xy"] * m["yx"]
    if not det or not math.isfinite(det):
        raise ValueError("the transform can't be inverted")
    return m["yy"] / det, -m["xy"] / det, -m["yx"] / det, m["xx"] / det


def moved(points: DataFrame, m) -> DataFrame:
    """Points or vertices with ``x, y`` taken through a transform."""
    at = lambda r: m[r + "x"] * F.col("x") + m[r + "y"] * F.col("y") + m[r + "o"]
    return points.withColumns({"x": at("x"), "y": at("y")})


def resample(labels: DataFrame, m) -> DataFrame:
    """Labels ``y, x, label`` on the grid that the transform leads to, without background.

    A pixel of the new grid takes the label of the pixel that holds its middle.  Every labelled pixel
    finds the new pixels that are its own among those its corners enclose: nothing is shuffled.
    """
    a, b, c, d = _inverse(m)
    x, y = F.col("x"), F.col("y")
    ends = {}
    for r in "xy":
        base = m[r + "x"] * x + m[r + "y"] * y + (m[r + "o"] - 0.5)
        low, high = (f(0.0, m[r + "x"]) + f(0.0, m[r + "y"]) for f in (min, max))
        ends[r] = F.explode(F.sequence(F.floor(base + (low - 1e-6)).cast("long"), F.ceil(base + (high + 1e-6)).cast("long")))
    near = labels.where("label <> 0").select("y", "x", "label", ends["y"].alias("ny")).withColumn("nx", ends["x"])
    u, v = F.col("nx") + (0.5 - m["xo"]), F.col("ny") + (0.5 - m["yo"])
    own = (F.floor(a * u + b * v) == x) & (F.floor(c * u + d * v) == y)
    return near.where(own).select(F.col("ny").alias("y"), F.col("nx").alias("x"), "label")


def image_window(pixels: DataFrame) -> DataFrame:
    """One row ``y0, x0, y1, x1`` around all pixels, with ends outside."""
    return pixels.agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def clip(labels: DataFrame, window: DataFrame) -> DataFrame:
    """Rows ``y, x, label`` inside a one-row window."""
    w = F.broadcast(window.select(*[F.col(c).alias("w" + c) for c in ("y0", "x0", "y1", "x1")]))
    return labels.crossJoin(w).where("y >= wy0 and y < wy1 and x >= wx0 and x < wx1").select("y", "x", "label")


def align(labels: DataFrame, window: DataFrame, m, mode: str = "strict") -> DataFrame:
    """Labels on the image's pixels, ``y, x, label`` without background.

    A shift by whole pixels moves them, and cells that aren't whole inside the window go.  Any other
    transform is refused by mode ``strict``; mode ``rasterize`` resamples, and cells at the window's
    border keep what is inside.  Raises where labels and window don't overlap.
    """
    if mode not in ("strict", "rasterize"):
        raise ValueError(f"unknown mode {mode}")
    if m["tx"] is None:
        if mode == "strict":
            raise ValueError(f"labels and image have different pixel grids: {[m[c] for c in MATRIX]}; mode 'rasterize' resamples the labels")
        inside = clip(resample(labels, m), window)
        if inside.isEmpty():
            raise ValueError("labels and image do not overlap")
        return inside
    here = labels.select((F.col("y") + m["ty"]).alias("y"), (F.col("x") + m["tx"]).alias("x"), "label")
    if clip(here, window).isEmpty():
        raise ValueError("labels and image do not overlap")
    return here.where("label <> 0").join(place(here, window).where("place = 'inside'").select("label"), "label", "left_semi").select("y", "x", "label")


def dropped(labels: DataFrame, window: DataFrame, m) -> DataFrame:
    """``place, n``: how many cells of shifted labels lie inside, partly and outside."""
    here = labels.select((F.col("y") + m["ty"]).alias("y"), (F.col("x") + m["tx"]).alias("x"), "label")
    return place(here, window).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


def polygon_spans(vertices: DataFrame) -> DataFrame:
    """Spans of polygons given as ``label, ring, k, x, y``, by the even-odd rule over all rings of a label.

    Rings close by themselves, whether or not the first vertex is repeated.  A middle on an edge counts
    as right of it, or below it, so polygons that share an edge share no pixel.  Vertices without a place are left out.
    """
    ring = Window.partitionBy("label", "ring").orderBy("k")
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    sides = vertices.where("x is not null and y is not null").withColumns({"ex": after("x"), "ey": after("y")}).where("y <> ey")
    row = lambda c: F.ceil(c - 0.5).cast("long")
    sides = sides.withColumns({"r0": row(F.least("y", "ey")), "r1": row(F.greatest("y", "ey")) - 1}).where("r0 <= r1")
    crossed = sides.withColumn("r", F.explode(F.sequence("r0", "r1")))
    at = F.col("x") + (F.col("r") + 0.5 - F.col("y")) * ((F.col("ex") - F.col("x")) / (F.col("ey") - F.col("y")))
    line = Window.partitionBy("label", "r").orderBy("at")
    found = crossed.select("label", "r", at.alias("at")).withColumns({"i": F.row_number().over(line), "to": F.lead("at").over(line)})
    spans = found.where("i % 2 = 1").select("label", F.col("r").alias("y"), row(F.col("at")).alias("x0"), row(F.col("to")).alias("x1"))
    return spans.where("x0 < x1")


def disc_spans(discs: DataFrame, m=None) -> DataFrame:
    """Spans of discs ``label, x, y, radius``, borders included, after a transform that may make ellipses of them."""
    m = m or IDENTITY
    a, b, c, d = _inverse(m)
    big, mixed, det = a * a + c * c, a * b + c * d, a * d - b * c
    here = moved(discs.where("x is not null and y is not null and radius >= 0"), m)
    reach = F.col("radius") * (math.sqrt(big) / abs(det))
    here = here.withColumns({"r0": F.ceil(F.col("y") - reach - 0.5).cast("long"), "r1": F.floor(F.col("y") + reach - 0.5).cast("long")}).where("r0 <= r1")
    rows = here.withColumn("r", F.explode(F.sequence("r0", "r1")))
    v = F.col("r") + 0.5 - F.col("y")
    half = F.sqrt(F.greatest(big * F.col("radius") * F.col("radius") - det * det * v * v, F.lit(0.0)))
    left, right = F.col("x") + (-mixed * v - half) / big, F.col("x") + (-mixed * v + half) / big
    spans = rows.select("label", F.col("r").alias("y"), F.ceil(left - 0.5).cast("long").alias("x0"), (F.floor(right - 0.5).cast("long") + 1).alias("x1"))
    return spans.where("x0 < x1")


def paint(spans: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """Spans as labels ``y, x, label``; where shapes overlap, the greatest label stays."""
    if window is not None:
        w = F.broadcast(window.select(*[F.col(c).alias("w" + c) for c in ("y0", "x0", "y1", "x1")]))
        cut = spans.crossJoin(w).where("y >= wy0 and y < wy1")
        spans = cut.select("label", "y", F.greatest("x0", "wx0").alias("x0"), F.least("x1", "wx1").alias("x1")).where("x0 < x1")
    return spans.select("label", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).groupBy("y", "x").agg(F.max("label").alias("label"))


def span_pixels(spans: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels ``y, x, c, val`` under each shape, with its ``label``; where shapes overlap, a pixel comes once for each.

    Spans and pixels meet by row and strip of 64 columns.
    """
    strip = lambda c: F.floor(c / float(STRIP)).cast("long")
    cut = spans.withColumn("strip", F.explode(F.sequence(strip(F.col("x0")), strip(F.col("x1") - 1))))
    met = pixels.withColumn("strip", strip(F.col("x"))).join(cut, ["y", "strip"]).where("x >= x0 and x < x1")
    # A label may have several spans in a row, but none of them share a pixel.
    return met.select("label", "y", "x", "c", "val")
