"""Queries over images and label rasters, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import blocks, cell_features, container, images, outline, qc, segmentation, sepal, stain, stitching, tiling, tissue
from tesserae.operators.pixel_classifier import PixelClassifier
from tesserae.plans import tile_sql
from tesserae.plans.book import register
from tesserae.session import materialise
from tesserae.sources import views


def _r(*names: str) -> list[F.Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


PX = views.with_views("pixels")
LB = views.with_views("pixels", "label_pixels")
CL = views.with_views("cell_pixels")
_TILED = PX + ", t AS MATERIALIZED (SELECT *, floor(y / 16.0)::BIGINT AS ty, floor(x / 21.0)::BIGINT AS tx FROM pixels), g AS MATERIALIZED (SELECT ty, tx, y, x, sum(val * CASE c WHEN 0 THEN 0.2126 WHEN 1 THEN 0.7152 ELSE 0.0722 END) AS val FROM t GROUP BY ALL)"


def _tiled(spark: SparkSession, sf: str) -> DataFrame:
    return images.tiles(views.pixels(spark, sf), 16, 21)


@register("image_gray", PX + " SELECT y, x, round(sum(val * CASE c WHEN 0 THEN 0.2125 WHEN 1 THEN 0.7154 ELSE 0.0721 END), 6) AS val FROM pixels GROUP BY y, x")
def _(spark, sf):
    return images.gray(views.pixels(spark, sf)).select("y", "x", *_r("val"))


@register("image_crop", PX + " SELECT i AS y, j AS x, c.c AS c, coalesce(p.val, -1.0) AS val FROM range(40) a(i), range(10) b(j), (VALUES (0), (1), (2)) c(c) LEFT JOIN pixels p ON p.y = i + 5 AND p.x = j + 15 AND p.c = c.c")
def _(spark, sf):
    return images.crop(views.pixels(spark, sf), 5, 15, 40, 10, cval=-1.0)


_MIRROR = "CASE WHEN o.{0} + k < 0 THEN -(o.{0} + k) - 1 WHEN o.{0} + k >= {1} THEN 2 * {1} - 1 - (o.{0} + k) ELSE o.{0} + k END"


@register(
    "image_smooth",
    PX
    + f""", s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS wd FROM pixels), e AS (SELECT k, exp(-0.5 * k * k) AS g FROM range(-4, 5) r(k)), kn AS (SELECT k, g / (SELECT sum(g) FROM e) AS g FROM e),
 a AS MATERIALIZED (SELECT o.y, o.x, o.c, sum(p.val * g) AS val FROM pixels o CROSS JOIN kn CROSS JOIN s JOIN pixels p ON p.x = o.x AND p.c = o.c AND p.y = {_MIRROR.format("y", "h")} GROUP BY ALL)
 SELECT o.y, o.x, o.c, round(sum(p.val * g), 6) AS val FROM a o CROSS JOIN kn CROSS JOIN s JOIN a p ON p.y = o.y AND p.c = o.c AND p.x = {_MIRROR.format("x", "wd")} GROUP BY ALL""",
)
def _(spark, sf):
    return images.smooth(views.pixels(spark, sf)).select("y", "x", "c", *_r("val"))


@register(
    "image_summary",
    PX + ', t AS (SELECT floor(y / 16.0)::BIGINT AS ty, c, val FROM pixels) SELECT ty, c, quantile_cont(val, 0.9) AS "q90", quantile_cont(val, 0.5) AS "q50", quantile_cont(val, 0.1) AS "q10", round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std FROM t GROUP BY ty, c',
)
def _(spark, sf):
    s = images.summary(_tiled(spark, sf), ["ty"])
    return s.select("ty", "c", F.col("`quantile_0.9`").alias("q90"), F.col("`quantile_0.5`").alias("q50"), F.col("`quantile_0.1`").alias("q10"), *_r("mean", "std"))


@register(
    "image_histogram",
    PX + ", t AS (SELECT *, floor(y / 16.0)::BIGINT AS ty FROM pixels), b AS (SELECT ty, min(val) AS lo, max(val) AS hi FROM t GROUP BY ty) SELECT t.ty, c, least(floor((val - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM t JOIN b ON t.ty = b.ty WHERE hi > lo GROUP BY ALL",
)
def _(spark, sf):
    return images.histogram(_tiled(spark, sf), ["ty"])


@register(
    "image_texture",
    PX
    + """, t AS (SELECT floor(y / 16.0)::BIGINT AS ty, y, x, c, val FROM pixels), o AS (SELECT a.ty, a.c, a.val AS i, b.val AS j FROM t a JOIN t b ON a.ty = b.ty AND a.c = b.c AND a.y = b.y AND b.x = a.x + 1),
 s AS (SELECT ty, c, i, j, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT ty, c, j, i FROM o) GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY ty, c) AS p FROM s),
 m AS (SELECT ty, c, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm_, sum(p * i) AS m, sum(p * i * i) AS q, sum(p * i * j) AS ij FROM p GROUP BY ALL)
 SELECT ty, c, round(contrast, 6) AS contrast, round(dissimilarity, 6) AS dissimilarity, round(homogeneity, 6) AS homogeneity, round(asm_, 6) AS "ASM", round(CASE WHEN q - m * m > 1e-12 THEN (ij - m * m) / (q - m * m) ELSE 1 END, 6) AS correlation FROM m""",
)
def _(spark, sf):
    return images.texture(_tiled(spark, sf), ["ty"]).select("ty", "c", *_r("contrast", "dissimilarity", "homogeneity", "ASM", "correlation"))


@register(
    "spot_features",
    PX
    + """, s AS (SELECT vec_id AS id, vec_id % 21 AS sx, vec_id AS sy FROM embeddings)
 SELECT id, c, count(*) AS n, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, min(val) AS min, max(val) AS max FROM s JOIN pixels ON abs(y - sy) <= 3 AND abs(x - sx) <= 3 GROUP BY ALL""",
)
def _(spark, sf):
    k = F.col("id")
    spots = views.spots(spark, sf).select("id", (k % 21).cast("double").alias("x"), k.cast("double").alias("y"))
    return images.spot_features(views.pixels(spark, sf), spots, 3).select("id", "c", "n", *_r("mean", "std"), "min", "max")


@register(
    "label_regions",
    LB
    + """, m AS (SELECT label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, var_pop(y) + 1.0 / 12 AS a, var_pop(x) + 1.0 / 12 AS b, covar_pop(y, x) AS c FROM label_pixels WHERE label <> 0 GROUP BY label),
 r AS (SELECT *, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS big, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS small FROM m)
 SELECT label, area, centroid_y, centroid_x, y0, x0, y1, x1, round(area / ((y1 - y0 + 1) * (x1 - x0 + 1)), 6) AS extent, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter,
 round(4 * sqrt(big), 6) AS major_axis_length, round(4 * sqrt(greatest(small, 0)), 6) AS minor_axis_length, round(sqrt(greatest(1 - small / big, 0)), 6) AS eccentricity FROM r""",
)
def _(spark, sf):
    r = images.regions(views.label_pixels(spark, sf))
    return r.select("label", "area", "centroid_y", "centroid_x", "y0", "x0", "y1", "x1", *_r("extent", "equivalent_diameter", "major_axis_length", "minor_axis_length", "eccentricity"))


@register("label_intensity", LB + " SELECT label, c, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, min(val) AS min, max(val) AS max FROM label_pixels JOIN pixels USING (y, x) WHERE label <> 0 GROUP BY label, c")
def _(spark, sf):
    return images.label_intensity(views.pixels(spark, sf), views.label_pixels(spark, sf)).select("label", "c", *_r("mean", "std"), "min", "max")


@register(
    "label_histogram",
    LB
    + """, j AS (SELECT label, c, val FROM label_pixels JOIN pixels USING (y, x) WHERE label <> 0), b AS (SELECT label, min(val) AS lo, max(val) AS hi FROM j GROUP BY label),
 n AS (SELECT j.label, c, least(floor((val - lo) / ((hi - lo) / 16)), 15)::INT AS bin, count(*) AS n FROM j JOIN b ON b.label = j.label WHERE hi > lo GROUP BY ALL) SELECT label, c, bin, round(n / sum(n) OVER (PARTITION BY label, c), 6) AS share FROM n""",
)
def _(spark, sf):
    return images.cell_histogram(views.pixels(spark, sf), views.label_pixels(spark, sf)).select("label", "c", "bin", *_r("share"))


@register("cell_features", LB + tile_sql.CELL_FEATURES)
def _(spark, sf):
    return cell_features.cell_features(views.label_pixels(spark, sf), views.pixels(spark, sf)).select("label", "feature", *_r("value"))


@register(
    "tile_specs",
    LB
    + """, m AS (SELECT label, avg(y) AS cy, avg(x) AS cx, greatest(max(y) - min(y) + 1, max(x) - min(x) + 1) AS e FROM label_pixels WHERE label <> 0 GROUP BY label)
 SELECT label, floor(cy / 64)::BIGINT AS ty, floor(cx / 64)::BIGINT AS tx, (SELECT (ceil(max(e) / 2.0) + 1)::BIGINT FROM m) AS margin FROM m""",
)
def _(spark, sf):
    return images.tile_specs(images.regions(views.label_pixels(spark, sf)), 64)


_BINS = PX + """, v AS (SELECT y, x, sum(val * CASE c WHEN 0 THEN 0.2125 WHEN 1 THEN 0.7154 ELSE 0.0721 END) AS val FROM pixels GROUP BY y, x), e AS (SELECT min(val) AS lo, max(val) AS hi FROM v),
 n AS (SELECT least(floor((val - lo) / ((hi - lo) / 256)), 255)::INT AS k, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM v, e GROUP BY 1),
 t AS (SELECT k, n, lo + (k + 0.5) * (hi - lo) / 256 AS t FROM n), c AS (SELECT k, t, sum(n) OVER (ORDER BY k) AS w0, sum(n * t) OVER (ORDER BY k) AS s0, sum(n) OVER () AS w, sum(n * t) OVER () AS s FROM t)"""


@register("otsu_threshold", _BINS + " SELECT round(arg_max(t, v * 1e6 - k * 1e-9), 6) AS threshold FROM (SELECT k, t, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) / (w * w), 9) AS v FROM c WHERE w0 < w)")
def _(spark, sf):
    return images.otsu(images.gray(views.pixels(spark, sf))).select(*_r("threshold"))


_CLASSED = """f AS (SELECT tile_id, count(*) AS n FROM t JOIN m ON m.y >= y0 AND m.y < y1 AND m.x >= x0 AND m.x < x1 GROUP BY tile_id),
 q AS (SELECT t.*, coalesce(n, 0) / CASE WHEN (least(y1, h) - greatest(y0, 0)) > 0 AND (least(x1, w) - greatest(x0, 0)) > 0 THEN (least(y1, h) - greatest(y0, 0)) * (least(x1, w) - greatest(x0, 0)) END AS share FROM t LEFT JOIN f USING (tile_id), s)"""
_KIND = "round(share, 6) AS tissue_fraction, CASE WHEN share >= 0.5 THEN 'tissue' WHEN coalesce(share, 0) = 0 THEN 'background' ELSE 'partial_tissue' END AS tile_classification, coalesce(share >= 0.5, false) AS suitable"


def _mask(spark: SparkSession, sf: str) -> DataFrame:
    return views.label_pixels(spark, sf).where("label <> 0").select("y", "x")


@register(
    "make_tiles",
    LB
    + f""", m AS MATERIALIZED (SELECT y, x FROM label_pixels WHERE label <> 0), s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pixels), k AS (SELECT avg(y) AS cy, avg(x) AS cx FROM m),
 o AS (SELECT h, w, round_even(cy - (floor(cy / 16) * 16 + 8), 0)::BIGINT AS oy, round_even(cx - (floor(cx / 8) * 8 + 4), 0)::BIGINT AS ox FROM s, k),
 d AS (SELECT *, (h - least(oy, 0) + 15) // 16 AS ny, (w - least(ox, 0) + 7) // 8 AS nx FROM o), r AS (SELECT *, unnest(range(ny)) AS ty FROM d), g AS (SELECT *, unnest(range(nx)) AS tx FROM r),
 t AS MATERIALIZED (SELECT concat('tile_x', tx, '_y', ty) AS tile_id, ty, tx, least(greatest(ty * 16 + oy, 0), h) AS y0, least(greatest(tx * 8 + ox, 0), w) AS x0,
  CASE WHEN ty = ny - 1 THEN h ELSE least(greatest(ty * 16 + oy + 16, 0), h) END AS y1, CASE WHEN tx = nx - 1 THEN w ELSE least(greatest(tx * 8 + ox + 8, 0), w) END AS x1 FROM g), {_CLASSED}
 SELECT tile_id, ty, tx, y0, x0, y1, x1, {_KIND} FROM q""",
)
def _(spark, sf):
    size, mask = tiling.image_size(views.pixels(spark, sf)), _mask(spark, sf)
    tiles = tiling.make_tiles(size, (16, 8), mask)
    return tiling.classify_tiles(tiles, mask, size, 0.5).withColumn("tissue_fraction", *_r("tissue_fraction"))


@register(
    "spot_tiles",
    LB
    + f""", m AS MATERIALIZED (SELECT y, x FROM label_pixels WHERE label <> 0), s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pixels),
 p AS (SELECT vec_id AS id, (vec_id % 3 * 7)::DOUBLE AS x, floor(vec_id / 3.0) * 7 + 3.5 AS y FROM embeddings), v AS (SELECT round(y - lag(y) OVER (ORDER BY y), 6) AS step FROM (SELECT DISTINCT y FROM p)),
 a AS (SELECT floor(step) AS side FROM v WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1),
 t AS MATERIALIZED (SELECT concat('spot_tile_', id) AS tile_id, id, floor(y - side / 2)::BIGINT AS y0, floor(x - side / 2)::BIGINT AS x0, ceil(y + side / 2)::BIGINT AS y1, ceil(x + side / 2)::BIGINT AS x1 FROM p, a), {_CLASSED}
 SELECT tile_id, id, y0, x0, y1, x1, {_KIND} FROM q""",
)
def _(spark, sf):
    k = F.col("id")
    spots = views.spots(spark, sf).select("id", (k % 3 * 7).cast("double").alias("x"), (F.floor(k / 3.0) * 7 + 3.5).cast("double").alias("y"))
    size, mask = tiling.image_size(views.pixels(spark, sf)), _mask(spark, sf)
    return tiling.classify_tiles(tiling.spot_tiles(spots), mask, size, 0.5).withColumn("tissue_fraction", *_r("tissue_fraction"))


@register("detect_tissue", PX + tile_sql.TISSUE)
def _(spark, sf):
    return tissue.detect_tissue(views.pixels(spark, sf), border_margin=(3, 2, 1, 0), min_specimen_share=0.0005, hole_share=0.0005, smoothing_cycles=1)


@register("detect_tissue_coarse", PX + tile_sql.TISSUE_COARSE)
def _(spark, sf):
    return tissue.detect_tissue(views.pixels(spark, sf), min_specimen_share=0.001, hole_share=0, n_samples=12, max_pixels=2700)


@register("detect_tissue_trained")
def _(spark, sf):
    return tissue.detect_tissue(views.pixels(spark, sf), border_margin=(3, 2, 1, 0), min_specimen_share=0.0005, hole_share=0.0005, classifier=PixelClassifier())


@register(
    "qc_brightness",
    _TILED + " SELECT ty, tx, round(avg(val), 6) AS brightness_mean, round(stddev_pop(val), 6) AS brightness_std, round(var_pop(val), 4) AS pop_variance FROM g GROUP BY ty, tx",
)
def _(spark, sf):
    level = images.gray(_tiled(spark, sf), "qc")
    a = level.groupBy("ty", "tx").agg(F.avg("val").alias("brightness_mean"), F.stddev_pop("val").alias("brightness_std"), F.round(F.var_pop("val"), 4).alias("pop_variance"))
    return a.select("ty", "tx", *_r("brightness_mean", "brightness_std"), "pop_variance")


_AROUND = "(SELECT a.ty, a.tx, a.y, a.x, i, j, n.val AS v FROM b a CROSS JOIN (VALUES (-1), (0), (1)) p(i) CROSS JOIN (VALUES (-1), (0), (1)) q(j) JOIN b n ON n.ty = a.ty AND n.tx = a.tx AND n.y = least(greatest(a.y + i, a.ya), a.yb) AND n.x = least(greatest(a.x + j, a.xa), a.xb))"


@register(
    "qc_sharpness",
    _TILED
    + f""", b AS MATERIALIZED (SELECT *, min(y) OVER w AS ya, max(y) OVER w AS yb, min(x) OVER w AS xa, max(x) OVER w AS xb FROM g WINDOW w AS (PARTITION BY ty, tx)),
 s AS (SELECT ty, tx, y, x, sum(v * i * (2 - abs(j))) AS gy, sum(v * j * (2 - abs(i))) AS gx, sum(v * CASE WHEN i = 0 AND j = 0 THEN -4 WHEN abs(i) + abs(j) = 1 THEN 1 ELSE 0 END) AS lap FROM {_AROUND} GROUP BY ALL)
 SELECT ty, tx, round(avg(gy * gy + gx * gx), 3) AS tenengrad_mean, round(var_pop(lap), 3) AS laplacian_variance FROM s GROUP BY ty, tx""",
)
def _(spark, sf):
    s = qc.sharpness(images.gray(_tiled(spark, sf), "qc"))
    return s.select("ty", "tx", F.round("tenengrad_mean", 3).alias("tenengrad_mean"), F.round("laplacian_variance", 3).alias("laplacian_variance"))


@register(
    "qc_entropy",
    _TILED
    + """, b AS (SELECT ty, tx, min(val) AS lo, max(val) AS hi FROM g GROUP BY ALL), n AS (SELECT ty, tx, CASE WHEN hi > lo THEN least(floor((val - lo) / ((hi - lo) / 256)), 255) ELSE 0 END AS k, count(*) AS n FROM g JOIN b USING (ty, tx) GROUP BY ALL),
 p AS (SELECT *, n / sum(n) OVER (PARTITION BY ty, tx) AS p FROM n) SELECT ty, tx, round(abs(sum(-p * log2(p))), 6) AS entropy FROM p GROUP BY ty, tx""",
)
def _(spark, sf):
    return qc.entropy(images.gray(_tiled(spark, sf), "qc")).select("ty", "tx", *_r("entropy"))


@register("qc_tile_metrics", _TILED + tile_sql.METRICS)
def _(spark, sf):
    m = qc.unfocus(qc.tile_metrics(_tiled(spark, sf)), ["tenengrad_mean", "laplacian_variance", "haar_wavelet_energy"])
    return m.select("ty", "tx", *_r(*[c for c in m.columns if c not in ("ty", "tx", "is_outlier")]), "is_outlier")


@register("qc_image", _TILED + tile_sql.QC_IMAGE)
def _(spark, sf):
    mask = images.gray(views.pixels(spark, sf), "qc").where("val >= 128")
    m = qc.qc_image(_tiled(spark, sf), mask)
    # Means of gray levels lie on ties of six digits.
    values = [F.round(c, 3 if c == "brightness_mean" else 6).alias(c) for c in m.columns if c not in ("ty", "tx", "is_tissue", "is_outlier")]
    return m.select("ty", "tx", *values, "is_tissue", "is_outlier")


@register("qc_high_frequencies", _TILED + tile_sql.HIGH_FREQUENCIES)
def _(spark, sf):
    return qc.high_frequencies(images.gray(_tiled(spark, sf), "qc")).select("ty", "tx", *_r("fft_high_freq_energy"))


@register("cut_scores", CL + tile_sql.CUT_SCORES + " SELECT label, area, y, x, round(ratio, 6) AS max_straight_edge_ratio, round(aligned, 6) AS cardinal_alignment_score, round(ratio * aligned, 6) AS cut_score FROM sc")
def _(spark, sf):
    return outline.cut_scores(views.cell_pixels(spark, sf)).select("label", "area", "y", "x", *_r("max_straight_edge_ratio", "cardinal_alignment_score", "cut_score"))


@register("tiling_qc", CL + tile_sql.TILING_QC)
def _(spark, sf):
    return qc.tiling_qc(views.cell_pixels(spark, sf)).select("label", *_r("cut_score", "smoothed_cut_score"), "is_outlier", *_r("nhood_outlier_fraction"))


@register("stitched_labels", CL + tile_sql.STITCHED)
def _(spark, sf):
    labels = views.cell_pixels(spark, sf)
    return qc.stitched_labels(labels, qc.stitch_groups(labels))


@register("stitched_table", CL + tile_sql.STITCHED_TABLE)
def _(spark, sf):
    """The pieces' areas, widths and places, with every strategy."""
    labels = views.cell_pixels(spark, sf)
    groups = materialise(qc.stitch_groups(labels), "groups")
    cells = materialise(labels.groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), (F.max("x") - F.min("x") + 1).alias("width"), F.concat(F.lit("tile"), F.col("label") % 4).alias("tile")), "cells")
    out = None
    for name in stitching.STRATEGIES:
        made = stitching.stitched_table(cells, groups, name)
        one = made.select(F.lit(name).alias("strategy"), "label", F.col("area").cast("double").alias("area"), F.col("width").cast("double").alias("width"), *_r("centroid_y", "centroid_x"), "tile", "is_stitched", "n_pieces")
        out = one if out is None else out.unionByName(one)
    return out


@register("cell_perimeters", CL + tile_sql.PERIMETERS)
def _(spark, sf):
    return outline.perimeters(views.cell_pixels(spark, sf)).select("label", *_r("perimeter", "perimeter_crofton"), "euler_number")


@register("cell_hulls")
def _(spark, sf):
    return outline.hulls(views.cell_pixels(spark, sf)).select("label", "area", "area_convex", *_r("solidity", "feret_diameter_max"))


@register("watershed")
def _(spark, sf):
    cells = views.cell_pixels(spark, sf, least=11, cut=False)  # large enough to touch
    labels = segmentation.watershed(blocks.to_blocks(cells.select("y", "x", F.lit(0).alias("c"), F.lit(1.0).alias("val"))), thresh=0.5)
    return blocks.to_pixels(labels, 0, above=0.0).select("y", "x", F.col("val").cast("long").alias("label"))


@register("segment_chunked", CL + " SELECT count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM cell_pixels GROUP BY label")
def _(spark, sf):
    image = blocks.to_blocks(views.cell_pixels(spark, sf).select("y", "x", F.lit(0).alias("c"), F.lit(1.0).alias("val")), 128)
    parts = segmentation.segment_chunks(image, segmentation.bright_regions, depth=0)
    rows = blocks.to_pixels(parts, 0, above=0.0)
    return rows.groupBy("val").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1")).drop("val")


@register(
    "distance_transform",
    CL + """, b AS (SELECT yy AS y, xx AS x FROM (SELECT max(y) AS h, max(x) AS w FROM cell_pixels), LATERAL (SELECT unnest(range(h + 1)) AS yy) u, LATERAL (SELECT unnest(range(w + 1)) AS xx) v ANTI JOIN cell_pixels p ON p.y = yy AND p.x = xx),
 r AS (SELECT DISTINCT y // 8 AS ty, x // 8 AS tx FROM cell_pixels), n AS (SELECT y, x, ty + i AS ty, tx + j AS tx FROM (SELECT *, y // 8 AS ty, x // 8 AS tx FROM b), range(-2, 3) p(i), range(-2, 3) q(j)), m AS (SELECT n.* FROM n SEMI JOIN r USING (ty, tx))
 SELECT c.y, c.x, min((c.y - m.y) * (c.y - m.y) + (c.x - m.x) * (c.x - m.x)) AS squared FROM (SELECT *, y // 8 AS ty, x // 8 AS tx FROM cell_pixels) c JOIN m USING (ty, tx) GROUP BY c.y, c.x""",
)
def _(spark, sf):
    image = blocks.to_blocks(views.cell_pixels(spark, sf).select("y", "x", F.lit(0).alias("c"), F.lit(1.0).alias("val")), 128)
    return blocks.to_pixels(segmentation.distance_transform(image), 1, above=0.0).select("y", "x", F.col("val").cast("long").alias("squared"))


@register("stain_density", PX + ", w AS (SELECT y, x, max(val) FILTER (c = 0) AS r, max(val) FILTER (c = 1) AS g, max(val) FILTER (c = 2) AS b FROM pixels GROUP BY y, x) SELECT y, x, round(-ln((r + 1) / 256.0), 6) AS r, round(-ln((g + 1) / 256.0), 6) AS g, round(-ln((b + 1) / 256.0), 6) AS b FROM w")
def _(spark, sf):
    rgb = qc.wide(views.pixels(spark, sf))
    return rgb.select("y", "x", *[F.round(c, 6).alias(n) for n, c in zip("rgb", stain.optical_density((255.0,) * 3), strict=True)])


@register("stain_macenko")
def _(spark, sf):
    rgb = qc.wide(views.pixels(spark, sf))
    own = stain.fit_macenko(rgb, max_angle=90.0)
    return stain.apply_macenko(rgb, own, own)


@register("stain_vahadane")
def _(spark, sf):
    rgb = qc.wide(views.pixels(spark, sf))
    own = stain.fit_vahadane(rgb, max_angle=90.0)
    return stain.concentrations(rgb, own).select("y", "x", *_r("hematoxylin", "eosin"))


@register("stain_reinhard", PX + tile_sql.REINHARD)
def _(spark, sf):
    rgb = qc.wide(views.pixels(spark, sf))
    own = stain.fit_reinhard(rgb)
    return stain.apply_reinhard(rgb, own, stain.StainReference("reinhard", mean=own.mean, std=tuple(s * 0.9 for s in own.std)))


@register("sepal")
def _(spark, sf):
    points = views.spots(spark, sf)
    return sepal.sepal(points, views.counts(spark, sf), max_neighs=4).select("lib", "gene", *_r("score"))


@register("container_shape", PX + " SELECT 'image' AS image_id, layer, max(y) + 1 AS height, max(x) + 1 AS width, 1::BIGINT AS depth, count(DISTINCT c) AS channels FROM (SELECT 'image' AS layer, * FROM pixels UNION ALL SELECT 'gray', y, x, 0, 0.0 FROM pixels WHERE c = 0) GROUP BY layer")
def _(spark, sf):
    box = container.ImageContainer.from_pixels(views.pixels(spark, sf))
    level = images.gray(box.layer("image")).withColumn("c", F.lit(0))
    return box.add(level, "gray").shape()


@register("container_apply", PX + " SELECT y, x, c, 255.0 - val AS val FROM pixels")
def _(spark, sf):
    box = container.ImageContainer.from_pixels(views.pixels(spark, sf))
    return box.apply(lambda p: p.assign(val=255.0 - p["val"]), "image", "inverse", chunk=64, depth=2).layer("inverse").select("y", "x", "c", "val")


@register(
    "container_segment",
    PX
    + """, g AS (SELECT y, x, sum(val * CASE c WHEN 0 THEN 0.2125 WHEN 1 THEN 0.7154 ELSE 0.0721 END) AS val FROM pixels GROUP BY y, x), m AS MATERIALIZED (SELECT y, x, y * (SELECT max(x) + 2 FROM g WHERE val >= 160) + x AS id FROM g WHERE val >= 160),
 near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), reach AS (SELECT id, id AS other FROM m UNION SELECT reach.id, near.b FROM reach JOIN near ON near.a = reach.other)
 SELECT y, x, min(other + 1)::DOUBLE AS val FROM reach JOIN m USING (id) GROUP BY y, x""",
)
def _(spark, sf):
    return container.ImageContainer.from_pixels(views.pixels(spark, sf)).segment("image", threshold=160.0).layer("segmented").select("y", "x", "val")
