"""Grids of image tiles, tiles around spots, and how much of each tile is tissue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.stats import number_rows

#: Side of the blocks by which tiles and mask pixels meet.
BLOCK = 64
CLASSES = ("background", "partial_tissue", "tissue")


def image_size(pixels: DataFrame) -> DataFrame:
    """One row ``h, w``: an image reaches from 0 to its last pixel; both null without pixels."""
    return pixels.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _shift(center: Column, step: int) -> Column:
    """From the middle of the tile that holds ``center`` to ``center``; halves go to even."""
    return F.coalesce(F.bround(center - (F.floor(center / step) * step + step / 2)).cast("long"), F.lit(0))


def _within(value: Column, high: str) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.col(high))


def make_tiles(size: DataFrame, tile_size: tuple[int, int] = (224, 224), mask: DataFrame | None = None) -> DataFrame:
    """``tile_id, ty, tx, y0, x0, y1, x1`` of a grid that covers an image of one size row.

    With a ``mask`` (``y, x`` of its pixels) the grid is moved so that a tile's middle is at the
    mask's centroid; an empty mask moves nothing.  The last row and column reach to the image's
    end, all bounds are cut at the image; an empty image has no tiles.
    """
    height, width = tile_size
    if height <= 0 or width <= 0:
        raise ValueError(f"tile_size must be positive, got {tile_size}")
    at = size.select("h", "w").where("h > 0 and w > 0")
    if mask is None:
        at = at.withColumns({"oy": F.lit(0), "ox": F.lit(0)})
    else:
        center = mask.agg(_shift(F.avg("y"), height).alias("oy"), _shift(F.avg("x"), width).alias("ox"))
        at = at.crossJoin(F.broadcast(center))
    count = lambda n, o, step: F.ceil((F.col(n) - F.least(F.col(o), F.lit(0))) / step).cast("long")
    at = at.withColumns({"ny": count("h", "oy", height), "nx": count("w", "ox", width)})
    grid = at.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    start = lambda i, o, step: F.col(i) * step + F.col(o)
    end = lambda i, n, o, step, high: F.when(F.col(i) == F.col(n) - 1, F.col(high)).otherwise(start(i, o, step) + step)
    return grid.select(
        F.concat(F.lit("tile_x"), "tx", F.lit("_y"), "ty").alias("tile_id"),
        "ty",
        "tx",
        _within(start("ty", "oy", height), "h").alias("y0"),
        _within(start("tx", "ox", width), "w").alias("x0"),
        _within(end("ty", "ny", "oy", height, "h"), "h").alias("y1"),
        _within(end("tx", "nx", "ox", width, "w"), "w").alias("x1"),
    )


def row_spacing(spots: DataFrame) -> DataFrame:
    """One row ``spacing``: the most frequent distance of neighboring rows of spots, the least of several."""
    rows = number_rows(spots.where("y is not null").select("y").distinct(), "y", "_r")
    after = rows.select(F.col("y").alias("_next"), (F.col("_r") - 1).alias("_r"))
    steps = rows.join(after, "_r").select(F.round(F.col("_next") - F.col("y"), 6).alias("step"))
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("spacing"))


def spot_tiles(spots: DataFrame, side: int | None = None) -> DataFrame:
    """``tile_id, id, y0, x0, y1, x1`` of the square around every spot, as wide as rows are apart."""
    if side is None:
        spacing = row_spacing(spots).first()["spacing"]
        if spacing is None:
            raise ValueError("the spots have fewer than two rows, so there is no spacing")
        side = max(1, int(spacing))
    if side <= 0:
        raise ValueError(f"side must be positive, got {side}")
    edge = lambda f, c, by: f(F.col(c) + by).cast("long")
    half = side / 2
    return spots.select(
        F.concat(F.lit("spot_tile_"), "id").alias("tile_id"),
        "id",
        edge(F.floor, "y", -half).alias("y0"),
        edge(F.floor, "x", -half).alias("x0"),
        edge(F.ceil, "y", half).alias("y1"),
        edge(F.ceil, "x", half).alias("x1"),
    )


def classify_tiles(tiles: DataFrame, mask: DataFrame, size: DataFrame, min_tissue_fraction: float = 1.0) -> DataFrame:
    """Adds ``tissue_fraction``, ``tile_classification`` and ``suitable`` to tiles with a unique ``tile_id``.

    Only the part of a tile inside the mask's size counts; a tile wholly outside is background.
    Tiles may overlap.  Blocks wholly inside a tile bring their count of mask pixels; only blocks
    at a tile's border meet the pixels themselves.
    """
    low = lambda c, n: _within(F.col(c), n)
    inside = tiles.crossJoin(F.broadcast(size)).select("tile_id", low("y0", "h").alias("a"), low("x0", "w").alias("b"), low("y1", "h").alias("c"), low("x1", "w").alias("d"))
    inside = inside.withColumn("area", F.greatest((F.col("c") - F.col("a")) * (F.col("d") - F.col("b")), F.lit(0)))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    blocks = lambda i, j: F.explode(F.sequence(block(i), F.floor((F.col(j) - 1) / BLOCK)))
    met = inside.where("c > a and d > b").withColumn("by", blocks("a", "c")).withColumn("bx", blocks("b", "d"))
    first = lambda c: F.col(c) * BLOCK
    whole = (first("by") >= F.col("a")) & (first("by") + BLOCK <= F.col("c")) & (first("bx") >= F.col("b")) & (first("bx") + BLOCK <= F.col("d"))
    dots = mask.select("y", "x", block("y").alias("by"), block("x").alias("bx"))
    full = met.where(whole).join(dots.groupBy("by", "bx").agg(F.count(F.lit(1)).alias("n")), ["by", "bx"]).select("tile_id", "n")
    rest = met.where(~whole).join(dots, ["by", "bx"]).where("y >= a and y < c and x >= b and x < d").groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    counts = full.union(rest).groupBy("tile_id").agg(F.sum("n").alias("n"))
    share = F.coalesce(F.col("n"), F.lit(0)) / F.when(F.col("area") > 0, F.col("area"))
    judged = inside.join(counts, "tile_id", "left").select("tile_id", share.alias("tissue_fraction"))
    enough = F.coalesce(F.col("tissue_fraction") >= min_tissue_fraction, F.lit(False))
    background, partial, tissue = map(F.lit, CLASSES)
    kind = F.when(enough, tissue).when(F.coalesce("tissue_fraction", F.lit(0.0)) == 0, background).otherwise(partial)
    return tiles.join(judged, "tile_id", "left").withColumns({"tile_classification": kind, "suitable": enough})


def spot_classes(spots: DataFrame, tiles: DataFrame) -> DataFrame:
    """The spots with the class of their tile; null for a spot without one."""
    return spots.join(tiles.select("id", "tile_classification"), "id", "left")
