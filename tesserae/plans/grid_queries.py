"""Queries over shapes and labels on different grids, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import alignment, physical, stitch_shapes
from tesserae.plans import tile_sql
from tesserae.plans.book import register
from tesserae.sources import views

#: Transforms of the queries' elements, in the order of ``alignment.MATRIX``.
TRANSFORMS = {
    ("image", "global"): (1.0, 0.0, 20.0, 0.0, 1.0, 30.0),
    ("shifted", "global"): (1.0, 0.0, 13.0, 0.0, 1.0, -5.0),
    ("shifted", "atlas"): (3.0, 0.0, 0.0, 0.0, 3.0, 0.0),
    ("turned", "global"): (1.0, 0.5, 30.25, -0.5, 0.75, 230.0),
    ("scan", "slide"): (0.5, 0.0, 0.0, 0.0, 0.5, 0.0),
    ("spots", "slide"): (1.0, 0.5, 0.0, 0.0, 1.0, 0.0),
}


def _between(spark: SparkSession, image: str, labels: str):
    rows = [(e, s, *m) for (e, s), m in TRANSFORMS.items()]
    known = spark.createDataFrame(rows, "element string, system string, " + ", ".join(f"{c} double" for c in alignment.MATRIX))
    return alignment.between(known, image, labels)


_CELLS = views.with_views("cell_pixels") + ", w AS (SELECT min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM cell_pixels)"


@register(
    "labels_shifted",
    _CELLS
    + """, b AS (SELECT label, count(*) AS area, min(y) - 35 AS a, max(y) - 35 AS b, min(x) - 7 AS l, max(x) - 7 AS r FROM cell_pixels GROUP BY label)
 SELECT label, area, a AS top, b AS bottom, l AS "left", r AS "right" FROM b CROSS JOIN w WHERE a >= y0 AND b < y1 AND l >= x0 AND r < x1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whole in the image after a shift by whole pixels."""
    cells = views.cell_pixels(spark, sf)
    here = alignment.align(cells, alignment.image_window(cells), _between(spark, "image", "shifted"))
    return here.groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left"), F.max("x").alias("right"))


@register(
    "labels_resampled",
    _CELLS
    + """, g AS (SELECT yy AS y, xx AS x, xx + 0.5 - 10.25 AS u, yy + 0.5 - 200.0 AS v FROM w, LATERAL (SELECT unnest(range(y0, y1)) AS yy) a, LATERAL (SELECT unnest(range(x0, x1)) AS xx) b)
 SELECT g.y, g.x, p.label FROM g JOIN cell_pixels p ON p.x = floor(0.75 * u - 0.5 * v)::BIGINT AND p.y = floor(0.5 * u + 1.0 * v)::BIGINT""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Cells on a grid that is turned and stretched against their own."""
    cells = views.cell_pixels(spark, sf)
    return alignment.align(cells, alignment.image_window(cells), _between(spark, "image", "turned"), "rasterize")


@register(
    "polygon_labels",
    views.with_views("polygons")
    + """, s AS MATERIALIZED (SELECT label, x, y, lead(x, 1, x0) OVER o AS ex, lead(y, 1, y0) OVER o AS ey FROM (SELECT *, first(x) OVER (PARTITION BY label, ring ORDER BY k) AS x0, first(y) OVER (PARTITION BY label, ring ORDER BY k) AS y0 FROM polygons) WINDOW o AS (PARTITION BY label, ring ORDER BY k)),
 b AS (SELECT label, floor(min(x))::BIGINT AS l, floor(max(x))::BIGINT AS r, floor(min(y))::BIGINT AS a, floor(max(y))::BIGINT AS b FROM s GROUP BY label),
 g AS (SELECT label, yy AS y, xx AS x FROM b, LATERAL (SELECT unnest(range(a, b + 1)) AS yy) m, LATERAL (SELECT unnest(range(l, r + 1)) AS xx) n)
 SELECT g.y, g.x, g.label FROM g JOIN s USING (label) WHERE (s.y <= g.y + 0.5) <> (s.ey <= g.y + 0.5) AND s.x + (g.y + 0.5 - s.y) * ((s.ex - s.x) / (s.ey - s.y)) <= g.x + 0.5 GROUP BY g.y, g.x, g.label HAVING count(*) % 2 = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons with holes as labels."""
    return alignment.paint(alignment.polygon_spans(views.polygons(spark, sf))).select("y", "x", "label")


@register(
    "disc_labels",
    views.with_views("discs")
    + """, m AS (SELECT label, 2.0 * x + y AS x, 2.0 * y AS y, radius FROM discs), g AS (SELECT label, radius, floor(x)::BIGINT + i AS px, floor(y)::BIGINT + j AS py, floor(x) + i + 0.5 - x AS u, floor(y) + j + 0.5 - y AS v FROM m, range(-18, 19) a(i), range(-14, 15) b(j))
 SELECT py AS y, px AS x, max(label) AS label FROM g WHERE (0.5 * u - 0.25 * v) * (0.5 * u - 0.25 * v) + 0.25 * v * v <= radius * radius GROUP BY py, px""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Discs that a sheared transform makes ellipses of, as labels."""
    return alignment.paint(alignment.disc_spans(views.discs(spark, sf), _between(spark, "scan", "spots"))).select("y", "x", "label")


@register(
    "shape_intensity",
    views.with_views("polygons", "cell_pixels")
    + """, b AS (SELECT label, min(x) AS l, max(x) AS r, min(y) AS a, max(y) AS b FROM polygons WHERE ring = 0 GROUP BY label), p AS MATERIALIZED (SELECT *, y // 32 AS ty, x // 32 AS tx FROM cell_pixels), near AS (SELECT b.label, p.y, p.x, p.label AS val FROM (SELECT *, unnest(range(floor(a / 32)::BIGINT, floor(b / 32)::BIGINT + 1)) AS ty FROM b) b JOIN p ON p.ty = b.ty AND p.tx BETWEEN floor(l / 32) AND floor(r / 32)),
 s AS MATERIALIZED (SELECT label, x, y, lead(x, 1, x0) OVER o AS ex, lead(y, 1, y0) OVER o AS ey FROM (SELECT *, first(x) OVER (PARTITION BY label, ring ORDER BY k) AS x0, first(y) OVER (PARTITION BY label, ring ORDER BY k) AS y0 FROM polygons) WINDOW o AS (PARTITION BY label, ring ORDER BY k)),
 f AS (SELECT g.label, g.val FROM near g JOIN s USING (label) WHERE (s.y <= g.y + 0.5) <> (s.ey <= g.y + 0.5) AND s.x + (g.y + 0.5 - s.y) * ((s.ex - s.x) / (s.ey - s.y)) <= g.x + 0.5 GROUP BY g.label, g.y, g.x, g.val HAVING count(*) % 2 = 1)
 SELECT label, count(*) AS n, avg(val % 256) AS mean, min(val % 256)::DOUBLE AS low FROM f GROUP BY label""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels under each polygon, met by row and strip."""
    image = views.cell_pixels(spark, sf).select("y", "x", F.lit(0).alias("c"), (F.col("label") % 256).cast("double").alias("val"))
    under = alignment.span_pixels(alignment.polygon_spans(views.polygons(spark, sf)), image)
    return under.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"), F.min("val").alias("low"))


@register(
    "microns_per_pixel",
    views.with_views("discs", "polygons")
    + """, d AS (SELECT sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS v FROM discs a JOIN discs b ON a.label <> b.label GROUP BY a.label),
 c AS (SELECT label, avg(x) AS x, avg(y) AS y FROM polygons WHERE ring = 1 GROUP BY label), e AS (SELECT sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS v FROM c a JOIN c b ON a.label <> b.label GROUP BY a.label)
 SELECT 'spacing' AS known, round(100 / (2 * quantile_cont(v, 0.5)), 9) AS mpp FROM d UNION ALL SELECT 'spacing of polygons', round(100 / quantile_cont(v, 0.5), 9) FROM e UNION ALL SELECT 'diameter', round(55 / (2 * 2 * quantile_cont(radius, 0.5)), 9) FROM discs UNION ALL SELECT 'edge', round(2 / sqrt(quantile_cont(w * w, 0.5)), 9) FROM (SELECT max(x) - min(x) AS w FROM polygons WHERE ring = 1 GROUP BY label)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Discs at twice their size by spacing and diameter; polygons' holes, which are squares, by edge and spacing."""
    discs, twice = views.discs(spark, sf), {"xx": 0.0, "xy": -2.0, "xo": 5.0, "yx": 2.0, "yy": 0.0, "yo": 1.0}
    squares = views.polygons(spark, sf).where("ring = 1")
    made = {
        "spacing": physical.microns_per_pixel(discs, twice, between_centers=100.0),
        "spacing of polygons": physical.microns_per_pixel(squares, between_centers=100.0),
        "diameter": physical.microns_per_pixel(discs, twice, diameter=55.0),
        "edge": physical.microns_per_pixel(squares, square_edge=2.0),
    }
    return spark.createDataFrame(list(made.items()), "known string, mpp double").withColumn("mpp", F.round("mpp", 9))


@register("stitch_candidates", views.with_views("cell_pixels") + tile_sql.STITCH_CANDIDATES)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of pieces that face each other, with the parts of their score that need no pixels."""
    pairs = stitch_shapes.candidate_pairs(views.cell_pixels(spark, sf), stitch_shapes.Stitching())
    return pairs.select("axis", "a", "b", *[F.round(c, 6).alias(c) for c in stitch_shapes.PLACED])


@register("stitched_by_shape")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of pieces whose closed unions look like cells."""
    groups = stitch_shapes.stitch_by_shape(views.cell_pixels(spark, sf))
    return groups.withColumn("confidence", F.round("confidence", 6))
