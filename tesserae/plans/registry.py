"""Every query of the library and its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.operators import autocorr, graph, graph_stats, ligrec, near_graph, niche, patterns, tables
from tesserae.plans import grid_queries, image_queries  # noqa: F401  # they enter their queries in the book
from tesserae.plans.book import ORACLES, QUERIES, register  # noqa: F401
from tesserae.sources import views
from tesserae.streaming import windows

ROUND = 6


def _r(c: str) -> F.Column:
    return F.round(F.col(c), ROUND).alias(c)


#: Edges of the lattice within one step, for SQL.
LATTICE_EDGES = "e AS MATERIALIZED (SELECT a.lib, a.id AS src, b.id AS dst, 1.0::DOUBLE AS w, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM lattice a JOIN lattice b ON a.lib = b.lib AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0)"
LATTICE = views.with_views("lattice") + ", " + LATTICE_EDGES
CLOUD_NEAR = "near AS (SELECT a.lib, a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cloud a JOIN cloud b ON a.lib = b.lib AND a.id <> b.id)"
SPOT_EDGES = "e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS w FROM spots a JOIN spots b ON a.lib = b.lib AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0)"


def lattice_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = views.lattice(spark, sf_dir)
    return points, graph.radius_edges(points, 1.0)


def spot_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = views.spots(spark, sf_dir)
    return points, graph.radius_edges(points, 1.0)


@register("radius_graph", views.with_views("cloud") + f", {CLOUD_NEAR} SELECT lib, src, dst, 1.0::DOUBLE AS w, round(sqrt(d2), 6) AS dist FROM near WHERE d2 <= 80.0 * 80.0")
def _(spark, sf):
    return graph.Radius(80.0).build(views.cloud(spark, sf)).withColumn("dist", F.round("dist", ROUND))


@register("radius_interval_graph", views.with_views("cloud") + f", {CLOUD_NEAR} SELECT lib, src, dst, 1.0::DOUBLE AS w, round(sqrt(d2), 6) AS dist FROM near WHERE d2 <= 6400.0 AND sqrt(d2) BETWEEN 30 AND 80")
def _(spark, sf):
    return graph.Radius((30.0, 80.0)).build(views.cloud(spark, sf)).withColumn("dist", F.round("dist", ROUND))


@register("knn_graph", views.with_views("cloud") + f", {CLOUD_NEAR} SELECT lib, src, dst, 1.0::DOUBLE AS w, round(sqrt(d2), 6) AS dist FROM near QUALIFY row_number() OVER (PARTITION BY lib, src ORDER BY d2, dst) <= 6")
def _(spark, sf):
    return graph.KNN(6).build(views.cloud(spark, sf)).withColumn("dist", F.round("dist", ROUND))


@register(
    "knn_percentile_graph",
    views.with_views("cloud")
    + f""", {CLOUD_NEAR}, k AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY lib, src ORDER BY d2, dst) <= 6),
 q AS (SELECT lib, quantile_cont(d, 0.9) AS m FROM (SELECT lib, sqrt(d2) AS d FROM k UNION ALL SELECT lib, 0.0 FROM cloud) GROUP BY lib)
 SELECT k.lib, src, dst, 1.0::DOUBLE AS w, round(sqrt(d2), 6) AS dist FROM k JOIN q ON k.lib = q.lib WHERE sqrt(d2) <= m + 1e-9""",
)
def _(spark, sf):
    return graph.KNN(6, percentile_=90.0).build(views.cloud(spark, sf)).withColumn("dist", F.round("dist", ROUND))


@register(
    "grid_rings_graph",
    LATTICE
    + """, r1 AS (SELECT lib, src, dst FROM e), r2 AS (SELECT DISTINCT a.lib, a.src, b.dst FROM r1 a JOIN r1 b ON a.lib = b.lib AND a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT * FROM r1)
 SELECT lib, src, dst, 1.0::DOUBLE AS w, 1.0::DOUBLE AS dist FROM r1 UNION ALL SELECT lib, src, dst, 1.0, 2.0 FROM r2""",
)
def _(spark, sf):
    return graph.ring_edges(lattice_graph(spark, sf)[1], 2)


@register("spectral_graph", LATTICE + ", s AS (SELECT src, sum(w) AS s FROM e GROUP BY src) SELECT e.lib, e.src, e.dst, round(w / sqrt(a.s * b.s), 6) AS w, round(dist, 6) AS dist FROM e JOIN s a ON e.src = a.src JOIN s b ON e.dst = b.src")
def _(spark, sf):
    return graph.spectral(lattice_graph(spark, sf)[1]).select("lib", "src", "dst", _r("w"), _r("dist"))


@register("cosine_graph", LATTICE + ", n AS (SELECT src, sqrt(sum(w * w)) AS n FROM e GROUP BY src) SELECT a.lib, a.src, b.src AS dst, round(sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)), 6) AS w FROM e a JOIN e b ON a.dst = b.dst JOIN n x ON x.src = a.src JOIN n y ON y.src = b.src GROUP BY a.lib, a.src, b.src")
def _(spark, sf):
    return graph.cosine(lattice_graph(spark, sf)[1]).select("lib", "src", "dst", _r("w"))


@register(
    "delaunay_graph",
    views.with_views("cloud")
    + """, t AS (SELECT a.lib, a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS b_y, c.x - a.x AS cx, c.y - a.y AS cy FROM cloud a JOIN cloud b ON a.lib = b.lib AND a.id < b.id JOIN cloud c ON c.lib = a.lib AND b.id < c.id),
 d AS (SELECT *, 2 * (bx * cy - b_y * cx) AS d FROM t), o AS (SELECT lib, a, b, c, ax, ay, (cy * (bx * bx + b_y * b_y) - b_y * (cx * cx + cy * cy)) / d AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + b_y * b_y)) / d AS uy FROM d WHERE abs(d) > 1e-9),
 k AS MATERIALIZED (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM cloud p WHERE p.lib = o.lib AND p.id <> a AND p.id <> b AND p.id <> c AND (p.x - ax - ux) * (p.x - ax - ux) + (p.y - ay - uy) * (p.y - ay - uy) < ux * ux + uy * uy)),
 s AS (SELECT lib, a AS src, b AS dst FROM k UNION SELECT lib, b, c FROM k UNION SELECT lib, a, c FROM k), e AS (SELECT * FROM s UNION ALL SELECT lib, dst, src FROM s)
 SELECT e.lib, src, dst, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 6) AS dist FROM e JOIN cloud p ON p.id = src JOIN cloud q ON q.id = dst""",
)
def _(spark, sf):
    return graph.Delaunay().build(views.cloud(spark, sf)).select("lib", "src", "dst", _r("dist"))


POLYGON = [(5.0, 1.0), (30.0, 1.0), (30.0, 200.0), (17.5, 4.5), (5.0, 200.0)]


def _masked_sql() -> str:
    sides = ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))
    odd = lambda x, y: f"sum(((py > {y}) <> (qy > {y}) AND {x} < (qx - px) * ({y} - py) / nullif(qy - py, 0) + px)::INT) % 2 = 1"
    turn = lambda a, b, c: f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"
    cut = f"{turn('s', 'e', 'p')} * {turn('s', 'e', 'q')} < 0 AND {turn('p', 'q', 's')} * {turn('p', 'q', 'e')} < 0"
    return (
        LATTICE
        + f""", g(px, py, qx, qy) AS (VALUES {sides}), l AS (SELECT e.lib, src, dst, a.x AS sx, a.y AS sy, b.x AS ex, b.y AS ey FROM e JOIN lattice a ON a.id = src JOIN lattice b ON b.id = dst)
 SELECT lib, src, dst FROM l CROSS JOIN g GROUP BY ALL HAVING {odd('sx', 'sy')} AND {odd('ex', 'ey')} AND {odd('((sx + ex) / 2)', '((sy + ey) / 2)')} AND NOT bool_or({cut})"""
    )


@register("masked_graph", _masked_sql())
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return graph.mask_edges(edges, points, POLYGON).select("lib", "src", "dst")


_PAIRS = "p AS (SELECT a.cl AS cluster_src, b.cl AS cluster_dst FROM (SELECT DISTINCT cl FROM lattice) a, (SELECT DISTINCT cl FROM lattice) b), f AS (SELECT a.cl AS cluster_src, b.cl AS cluster_dst, count(*) AS n FROM e JOIN lattice a ON e.src = a.id JOIN lattice b ON e.dst = b.id GROUP BY ALL)"


@register("interaction_matrix", LATTICE + f", {_PAIRS} SELECT p.cluster_src, p.cluster_dst, coalesce(n, 0)::DOUBLE AS value FROM p LEFT JOIN f ON p.cluster_src = f.cluster_src AND p.cluster_dst = f.cluster_dst")
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return graph_stats.interaction_matrix(edges, points)


@register("interaction_matrix_normalized", LATTICE + f", {_PAIRS} SELECT p.cluster_src, p.cluster_dst, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY p.cluster_src), 6) AS value FROM p LEFT JOIN f ON p.cluster_src = f.cluster_src AND p.cluster_dst = f.cluster_dst")
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return graph_stats.interaction_matrix(edges, points, normalized=True).select("cluster_src", "cluster_dst", _r("value"))


PERMS, SEED = 20, 3
#: Permutations of the queries that have no SQL.
ALL_PERMS = 1000


@register(
    "nhood_enrichment",
    LATTICE
    + f""", {_PAIRS}, d AS MATERIALIZED {stats.permuted_sql('lattice', PERMS, SEED)},
 s AS (SELECT d1.perm, d1.cl AS cluster_src, d2.cl AS cluster_dst, count(*) AS n FROM e JOIN d d1 ON e.src = d1.id JOIN d d2 ON e.dst = d2.id AND d1.perm = d2.perm GROUP BY ALL),
 m AS (SELECT cluster_src, cluster_dst, sum(n) AS s1, sum(n * n) AS s2 FROM s GROUP BY ALL)
 SELECT p.cluster_src, p.cluster_dst, coalesce(n, 0)::BIGINT AS count,
  round(CASE WHEN s2 * {PERMS} - s1 * s1 > 0 THEN (coalesce(n, 0) * {PERMS} - s1) / sqrt((s2 * {PERMS} - s1 * s1)::DOUBLE) END, 6) AS zscore
 FROM p LEFT JOIN f USING (cluster_src, cluster_dst) LEFT JOIN m USING (cluster_src, cluster_dst)""",
)
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return graph_stats.nhood_enrichment(edges, points, n_perms=PERMS, seed=SEED).select("cluster_src", "cluster_dst", "count", _r("zscore"))


@register(
    "nhood_enrichment_by_library",
    LATTICE
    + f""", {_PAIRS}, d AS MATERIALIZED {stats.permuted_sql('lattice', PERMS, SEED, by=['lib'])},
 s AS (SELECT d1.perm, d1.cl AS cluster_src, d2.cl AS cluster_dst, count(*) AS n FROM e JOIN d d1 ON e.src = d1.id JOIN d d2 ON e.dst = d2.id AND d1.perm = d2.perm GROUP BY ALL),
 m AS (SELECT cluster_src, cluster_dst, sum(n) AS s1, sum(n * n) AS s2 FROM s GROUP BY ALL)
 SELECT p.cluster_src, p.cluster_dst, coalesce(n, 0)::BIGINT AS count,
  round(CASE WHEN s2 * {PERMS} - s1 * s1 > 0 THEN (coalesce(n, 0) * {PERMS} - s1) / sqrt((s2 * {PERMS} - s1 * s1)::DOUBLE) END, 6) AS zscore
 FROM p LEFT JOIN f USING (cluster_src, cluster_dst) LEFT JOIN m USING (cluster_src, cluster_dst)""",
)
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return graph_stats.nhood_enrichment(edges, points, n_perms=PERMS, seed=SEED, by=["lib"]).select("cluster_src", "cluster_dst", "count", _r("zscore"))


_CLOUD_E = "e AS MATERIALIZED (SELECT src, dst FROM near WHERE d2 <= 150.0 * 150.0)"


@register(
    "centrality_scores",
    views.with_views("cloud")
    + f""", {CLOUD_NEAR}, {_CLOUD_E}, k AS (SELECT src, count(*) AS k FROM e GROUP BY src),
 t AS (SELECT a.src AS id, count(*) AS t FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst JOIN e c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
 cc AS (SELECT cloud.id, cl, coalesce(CASE WHEN k > 1 THEN t::DOUBLE / (k * (k - 1)) END, 0) AS c FROM cloud LEFT JOIN k ON k.src = cloud.id LEFT JOIN t ON t.id = cloud.id),
 size AS (SELECT cl, count(*) AS size, (SELECT count(*) FROM cloud) AS n FROM cloud GROUP BY cl),
 deg AS (SELECT a.cl, count(DISTINCT e.dst) AS d FROM e JOIN cloud a ON a.id = e.src JOIN cloud b ON b.id = e.dst WHERE a.cl <> b.cl GROUP BY a.cl)
 SELECT size.cl AS cluster, round(coalesce(d, 0) / (n - size), 6) AS degree_centrality, round((SELECT avg(c) FROM cc WHERE cc.cl = size.cl), 6) AS average_clustering FROM size LEFT JOIN deg ON deg.cl = size.cl""",
)
def _(spark, sf):
    out = near_graph.centrality_scores(views.cloud(spark, sf), 150.0, scores=["degree_centrality", "average_clustering"])
    return out.select("cluster", _r("degree_centrality"), _r("average_clustering"))


@register(
    "closeness_centrality",
    views.with_views("cloud")
    + f""", {CLOUD_NEAR}, {_CLOUD_E}, bfs AS (SELECT cl, id, 0 AS hops FROM cloud UNION SELECT bfs.cl, e.dst, hops + 1 FROM bfs JOIN e ON e.src = bfs.id WHERE hops < 40),
 far AS (SELECT cl, id, min(hops) AS h FROM bfs GROUP BY ALL) SELECT cl AS cluster, round(((SELECT count(*) FROM cloud) - count(*) FILTER (h = 0)) / sum(h), 6) AS closeness_centrality FROM far GROUP BY cl""",
)
def _(spark, sf):
    return near_graph.centrality_scores(views.cloud(spark, sf), 150.0, scores=["closeness_centrality"]).select("cluster", _r("closeness_centrality"))


_EXPR = views.with_views("spots", "counts") + f", {SPOT_EDGES}"
_MORAN_BASE = """, w AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM spots),
 g AS (SELECT gene, sum(value) / any_value(n) AS m FROM counts, n GROUP BY gene), x AS MATERIALIZED (SELECT s.id, g.gene, coalesce(c.value, 0) - m AS z FROM spots s CROSS JOIN g LEFT JOIN counts c ON c.id = s.id AND c.gene = g.gene),
 zz AS (SELECT gene, sum(z * z) AS zz FROM x GROUP BY gene), s0 AS (SELECT sum(w) AS s0 FROM w),
 s1 AS (SELECT sum((coalesce(a.w, 0) + coalesce(b.w, 0)) * (coalesce(a.w, 0) + coalesce(b.w, 0))) / 2 AS s1 FROM w a FULL JOIN w b ON a.src = b.dst AND a.dst = b.src),
 s2 AS (SELECT sum(t * t) AS s2 FROM (SELECT id, sum(w) AS t FROM (SELECT src AS id, w FROM w UNION ALL SELECT dst, w FROM w) GROUP BY id))"""


def _moran_sql(mode: str) -> str:
    if mode == "moran":
        stat = "any_value(n) / any_value(s0) * sum(w * a.z * b.z) / any_value(zz)"
        var, mean = "(n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1.0 / ((n - 1) * (n - 1))", "(-1.0 / (n - 1))"
    else:
        stat = "(any_value(n) - 1) / (2 * any_value(s0)) * sum(w * (a.z - b.z) * (a.z - b.z)) / any_value(zz)"
        var, mean = "((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)", "1.0"
    z = f"(abs(stat - {mean}) / sqrt({var}))"
    return _EXPR + _MORAN_BASE + f""", st AS (SELECT a.gene, {stat} AS stat FROM w JOIN x a ON a.id = w.src JOIN x b ON b.id = w.dst AND a.gene = b.gene JOIN zz ON zz.gene = a.gene, n, s0 GROUP BY a.gene),
 pv AS (SELECT gene, stat, {stats.normal_tail_sql(z)} AS p, {var} AS v FROM st, n, s0, s1, s2)
 SELECT gene, round(stat, 6) AS stat, round(p, 6) AS pval_norm, round(v, 6) AS var_norm,
 round(least(1.0, min(p * m / r) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 6) AS pval_norm_fdr_bh FROM (SELECT *, row_number() OVER (ORDER BY p, gene) AS r, count(*) OVER () AS m FROM pv)"""


for _mode in ("moran", "geary"):

    @register(f"spatial_autocorr_{_mode}", _moran_sql(_mode))
    def _(spark, sf, mode=_mode):
        points, edges = spot_graph(spark, sf)
        out = autocorr.spatial_autocorr(edges, points, views.counts(spark, sf), mode)
        return out.select("gene", *map(_r, ("stat", "pval_norm", "var_norm", "pval_norm_fdr_bh")))


#: Features of ``views.expr``.
_ALL_GENES = [f"g{i}" for i in range(64)]


def _permuted_moran_sql() -> str:
    """All permutations with a column for each feature, so that the edges are joined once for all of them."""
    wide = ", ".join(f"coalesce(any_value(z) FILTER (gene = '{g}'), 0) AS {g}" for g in _ALL_GENES)
    sums = ", ".join(f"sum(w * a.{g} * b.{g}) AS {g}" for g in _ALL_GENES)
    tail = stats.normal_tail_sql("(abs(stat + 1.0 / (n - 1)) / sqrt((n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1.0 / ((n - 1) * (n - 1))))")
    return (
        _EXPR
        + _MORAN_BASE
        + f""", wd AS MATERIALIZED (SELECT id, {wide} FROM x GROUP BY id), st AS (SELECT a.gene, any_value(n) / any_value(s0) * sum(w * a.z * b.z) / any_value(zz) AS stat FROM w JOIN x a ON a.id = w.src JOIN x b ON b.id = w.dst AND a.gene = b.gene JOIN zz ON zz.gene = a.gene, n, s0 GROUP BY a.gene),
 r AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM spots), d AS (SELECT perm, id, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws('|', {SEED}, perm, id)), id) AS r FROM spots, range({ALL_PERMS}) p(perm)),
 mv AS (SELECT perm, d.id AS src, dst, w FROM d JOIN r USING (r) JOIN w ON w.src = r.id), sm AS MATERIALIZED (SELECT perm, {sums} FROM mv JOIN wd a ON a.id = mv.src JOIN wd b ON b.id = dst GROUP BY perm),
 si AS (SELECT u.gene, n / s0 * u.v / zz AS sim FROM (UNPIVOT sm ON {', '.join(_ALL_GENES)} INTO NAME gene VALUE v) u JOIN zz ON zz.gene = u.gene, n, s0),
 ag AS (SELECT gene, any_value(stat) AS stat, sum((round(sim, 9) >= round(stat, 9))::INT) AS c, avg(sim) AS ms, var_pop(sim) AS v FROM si JOIN st USING (gene) GROUP BY gene)
 SELECT gene, round(stat, 6) AS stat, round({tail}, 6) AS pval_norm, round((least(c, {ALL_PERMS} - c) + 1) / {ALL_PERMS + 1}.0, 6) AS pval_sim, round({stats.normal_tail_sql('(abs(stat - ms) / sqrt(v))')}, 6) AS pval_z_sim, round(v, 6) AS var_sim FROM ag, n, s0, s1, s2"""
    )


@register("spatial_autocorr_permuted", _permuted_moran_sql())
def _(spark, sf):
    points, edges = spot_graph(spark, sf)
    out = autocorr.spatial_autocorr(edges, points, views.counts(spark, sf), n_perms=ALL_PERMS, seed=SEED)
    return out.select("gene", *map(_r, ("stat", "pval_norm", "pval_sim", "pval_z_sim", "var_sim")))


_RADII = [20.0, 40.0, 60.0, 80.0]


@register(
    "co_occurrence",
    views.with_views("cloud")
    + f""", r AS (SELECT unnest({_RADII}) AS r), c AS (SELECT DISTINCT cl FROM cloud),
 pr AS MATERIALIZED (SELECT a.cl AS i, b.cl AS c, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cloud a JOIN cloud b ON a.id <> b.id AND abs(a.x - b.x) <= 80 AND abs(a.y - b.y) <= 80),
 n AS (SELECT i, c, r.r AS r, count(*) AS n FROM pr JOIN r ON d2 <= r.r * r.r GROUP BY ALL), g AS (SELECT x.cl AS i, y.cl AS c, r.r AS r, coalesce(n, 0) AS n FROM c x CROSS JOIN c y CROSS JOIN r LEFT JOIN n ON n.i = x.cl AND n.c = y.cl AND n.r = r.r)
 SELECT i AS cluster_i, c AS cluster_c, r, round(CASE WHEN sum(n) OVER (PARTITION BY r, c) > 0 AND sum(n) OVER (PARTITION BY r, i) > 0 THEN (n / sum(n) OVER (PARTITION BY r, c)) / (sum(n) OVER (PARTITION BY r, i) / sum(n) OVER (PARTITION BY r)) ELSE 0 END, 6) AS ratio FROM g""",
)
def _(spark, sf):
    return patterns.co_occurrence(views.cloud(spark, sf), [0.0, *_RADII]).withColumn("ratio", F.round("ratio", ROUND))


_HULL = """, s AS (SELECT * FROM cloud), h AS (SELECT a.lib, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM s a JOIN s b ON a.lib = b.lib AND a.id <> b.id
 WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.lib = a.lib AND c.id <> a.id AND c.id <> b.id AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-9
  OR (abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) <= 1e-9 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))"""


@register("hull_areas", views.with_views("cloud") + _HULL + " SELECT lib, round(abs(sum(ax * b_y - bx * ay)) / 2, 4) AS area, count(*) AS corners FROM h GROUP BY lib")
def _(spark, sf):
    return patterns.hull_areas(views.cloud(spark, sf)).select("lib", F.round("area", 4).alias("area"), "corners")


_SUPPORT = [0.0, 20.0, 40.0, 60.0, 80.0]


@register(
    "ripley_l",
    views.with_views("cloud")
    + f""", b AS (SELECT unnest({_SUPPORT}) AS bin), c AS (SELECT DISTINCT cl FROM cloud), n AS (SELECT count(*)::DOUBLE AS n FROM cloud),
 pr AS MATERIALIZED (SELECT a.cl, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cloud a JOIN cloud b ON a.cl = b.cl AND a.id <> b.id AND abs(a.x - b.x) <= 80 AND abs(a.y - b.y) <= 80)
 SELECT c.cl AS cluster, bin, round(sqrt(count(d) / any_value(n) / (any_value(n) / 1000000.0) / pi()), 6) AS stat FROM c CROSS JOIN b CROSS JOIN n LEFT JOIN pr ON pr.cl = c.cl AND d <= bin + 1e-8 GROUP BY ALL""",
)
def _(spark, sf):
    return patterns.ripley_l(views.cloud(spark, sf), 1_000_000.0, _SUPPORT).withColumn("stat", F.round("stat", ROUND))


@register(
    "ripley_g",
    views.with_views("cloud")
    + f""", nn AS (SELECT b.cl AS cluster, a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cloud a JOIN cloud b ON a.cl <> b.cl QUALIFY row_number() OVER (PARTITION BY b.cl, a.id ORDER BY d, b.id) <= 2),
 s AS (SELECT unnest({_SUPPORT}) AS bin), t AS (SELECT cluster, count(*) FILTER (d <= 80) AS n FROM nn GROUP BY cluster)
 SELECT t.cluster, bin, round(CASE WHEN any_value(n) > 0 THEN count(nn.d)::DOUBLE / any_value(n) ELSE 0 END, 6) AS stat FROM t CROSS JOIN s LEFT JOIN nn ON nn.cluster = t.cluster AND (d < bin OR (bin = 80 AND d <= 80)) GROUP BY t.cluster, bin""",
)
def _(spark, sf):
    return patterns.ripley_g(views.cloud(spark, sf), _SUPPORT).withColumn("stat", F.round("stat", ROUND))


@register("ripley_simulated")
def _(spark, sf):
    return patterns.ripley(views.cloud(spark, sf), "L")


@register(
    "sliding_window",
    views.with_views("lattice")
    + """, b AS (SELECT lib, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM lattice GROUP BY lib),
 w AS (SELECT lib, i, j, row_number() OVER (PARTITION BY lib ORDER BY i, j) - 1 AS window_id, xa + i * 7 AS x0, least(xa + i * 7 + 7, xb) AS x1, ya + j * 7 AS y0, least(ya + j * 7 + 7, yb) AS y1
  FROM b, range(20) r(i), range(20) q(j) WHERE i < greatest(ceil((xb - xa) / 7), 1) AND j < greatest(ceil((yb - ya) / 7), 1))
 SELECT l.lib, l.id, max(window_id)::BIGINT AS window_id FROM lattice l JOIN w ON w.lib = l.lib AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY l.lib, l.id""",
)
def _(spark, sf):
    return tables.sliding_window(views.lattice(spark, sf), 7.0)


@register(
    "sliding_window_overlap",
    views.with_views("lattice")
    + """, b AS (SELECT lib, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM lattice GROUP BY lib),
 w AS (SELECT lib, i, j, row_number() OVER (PARTITION BY lib ORDER BY i, j) - 1 AS window_id, xa + i * 5 AS x0, least(xa + i * 5 + 8, xb) AS x1, ya + j * 5 AS y0, least(ya + j * 5 + 8, yb) AS y1
  FROM b, range(20) r(i), range(20) q(j) WHERE i < greatest(ceil((xb - xa) / 5), 1) AND j < greatest(ceil((yb - ya) / 5), 1))
 SELECT l.lib, l.id, window_id::BIGINT AS window_id FROM lattice l JOIN w ON w.lib = l.lib AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
)
def _(spark, sf):
    return tables.sliding_window(views.lattice(spark, sf), 8.0, 3.0)


_ANCHORS = ["AUTOMOBILE", "BUILDING"]


@register(
    "var_by_distance",
    views.with_views("lattice")
    + f""", d AS (SELECT p.lib, p.id, a.cl AS anchor, min(sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y))) AS d FROM lattice p JOIN lattice a ON p.lib = a.lib AND a.cl IN ('AUTOMOBILE', 'BUILDING') GROUP BY ALL),
 f AS (SELECT *, nullif(d, 0) AS p, row_number() OVER (PARTITION BY lib, anchor ORDER BY nullif(d, 0) NULLS LAST, id) AS r FROM d),
 g AS (SELECT *, CASE WHEN r = 1 AND p IS NOT NULL THEN 0.0 ELSE p END AS n FROM f)
 SELECT lib, id, anchor, round(d, 6) AS dist_raw, round(n / max(n) OVER (PARTITION BY lib, anchor), 6) AS dist_norm FROM g""",
)
def _(spark, sf):
    return tables.var_by_distance(views.lattice(spark, sf), _ANCHORS).select("lib", "id", "anchor", _r("dist_raw"), _r("dist_norm"))


_GENES = [("G0", "G1"), ("G2", "G3_G4"), ("G5", "G0"), ("G6", "G7"), ("G1", "G9_G8")]


def _ligrec_sql(perms: int = PERMS, digits: int = 6) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in _GENES)
    return (
        views.with_views("spots", "counts")
        + f""", i(source, target) AS (VALUES {pairs}), x AS MATERIALIZED (SELECT id, upper(gene) AS gene, value FROM counts), n AS (SELECT count(*)::DOUBLE AS n FROM spots),
 gm AS (SELECT gene, sum(value) / any_value(n) AS m FROM x, n GROUP BY gene),
 pt AS (SELECT source, (SELECT arg_min(gene, m) FROM gm WHERE gene IN (SELECT unnest(string_split(target, '_')))) AS target FROM i),
 sz AS (SELECT cl, count(*)::DOUBLE AS k FROM spots GROUP BY cl),
 cm AS (SELECT cl, gene, sum(value) / any_value(k) AS m, sum((value > 0)::INT) / any_value(k) AS f FROM x JOIN spots USING (id) JOIN sz USING (cl) GROUP BY ALL),
 ob AS (SELECT source, target, a.cl AS cluster_1, b.cl AS cluster_2, a.m AS m1, b.m AS m2, a.f >= 0.01 AND b.f >= 0.01 AND a.m > 0 AND b.m > 0 AS t FROM pt JOIN cm a ON a.gene = source JOIN cm b ON b.gene = target),
 d AS MATERIALIZED {stats.permuted_sql('spots', perms, SEED)},
 pm AS MATERIALIZED (SELECT perm, cl, gene, sum(value) / any_value(k) AS m FROM x JOIN d USING (id) JOIN sz USING (cl) GROUP BY ALL),
 pv AS (SELECT source, target, cluster_1, cluster_2, sum((round(coalesce(a.m, 0) + coalesce(b.m, 0), 9) > round(m1 + m2, 9))::INT) / {float(perms)} AS pvalue FROM ob CROSS JOIN range({perms}) p(perm)
  LEFT JOIN pm a ON a.perm = p.perm AND a.gene = source AND a.cl = cluster_1 LEFT JOIN pm b ON b.perm = p.perm AND b.gene = target AND b.cl = cluster_2 WHERE t GROUP BY ALL)
 SELECT ob.source, ob.target, ob.cluster_1, ob.cluster_2, round(CASE WHEN m1 > 0 AND m2 > 0 THEN (m1 + m2) / 2 ELSE 0 END, {digits}) AS mean, round(pvalue, {digits}) AS pvalue
 FROM ob LEFT JOIN pv ON ob.source = pv.source AND ob.target = pv.target AND ob.cluster_1 = pv.cluster_1 AND ob.cluster_2 = pv.cluster_2"""
    )


@register("ligrec", _ligrec_sql())
def _(spark, sf):
    pairs = ligrec.prepare_interactions(spark, _GENES)
    out = ligrec.ligrec(views.counts(spark, sf), views.spots(spark, sf).select("id", "cl"), pairs, n_perms=PERMS, seed=SEED)
    return out.select("source", "target", "cluster_1", "cluster_2", _r("mean"), _r("pvalue"))


_LIGREC_FDR = (
    f"WITH lr AS MATERIALIZED ({_ligrec_sql(ALL_PERMS, 12)}), raw AS (SELECT * EXCLUDE (pvalue), pvalue AS pv, coalesce(pvalue, 1.0) AS p FROM lr),"
    + """ rk AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY p, cluster_1, cluster_2) AS r, count(*) OVER (PARTITION BY source, target) AS m FROM raw),
 q AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY source, target ORDER BY p DESC, cluster_1 DESC, cluster_2 DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rk),
 k AS (SELECT * FROM q WHERE mean BETWEEN 0 AND 100 AND (pv IS NULL OR pv <= 1) QUALIFY bool_or(mean > 0) OVER (PARTITION BY source, target)), k2 AS (SELECT * FROM k QUALIFY bool_or(mean > 0) OVER (PARTITION BY cluster_1, cluster_2))
 SELECT source, target, cluster_1, cluster_2, round(mean, 6) AS mean, round(pv, 6) AS pvalue, round(CASE WHEN pv IS NOT NULL THEN q END, 6) AS pvalue_adj, round(log2(mean + 1), 6) AS log2_mean FROM k2"""
)


@register("ligrec_fdr", _LIGREC_FDR)
def _(spark, sf):
    pairs = ligrec.prepare_interactions(spark, _GENES)
    out = ligrec.ligrec(views.counts(spark, sf), views.spots(spark, sf).select("id", "cl"), pairs, n_perms=ALL_PERMS, seed=SEED, method="fdr_bh", axis="interactions")
    return ligrec.significant(out, means_range=(0.0, 100.0)).select("source", "target", "cluster_1", "cluster_2", _r("mean"), _r("pvalue"), _r("pvalue_adj"), _r("log2_mean"))


@register(
    "niche_profile",
    LATTICE
    + """, h2 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM e a JOIN e b ON a.dst = b.src GROUP BY ALL),
 p1 AS (SELECT src AS id, cl, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS s FROM e JOIN lattice l ON l.id = e.dst GROUP BY src, cl),
 p2 AS (SELECT src AS id, cl, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS s FROM h2 JOIN lattice l ON l.id = h2.dst GROUP BY src, cl),
 c AS (SELECT DISTINCT cl FROM lattice)
 SELECT l.id, c.cl, round((coalesce(p1.s, 0) * 1.0 + coalesce(p2.s, 0) * 0.5) / 1.5, 6) AS value FROM lattice l CROSS JOIN c LEFT JOIN p1 ON p1.id = l.id AND p1.cl = c.cl LEFT JOIN p2 ON p2.id = l.id AND p2.cl = c.cl""",
)
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return niche.neighborhood_profile(edges, points, distance=2, weights=[1.0, 0.5]).select("id", "cl", _r("value"))


@register("niche_utag_features", _EXPR + " SELECT src AS id, gene, round(sum(value) / any_value(k), 6) AS value FROM e JOIN counts ON counts.id = dst JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) USING (src) GROUP BY src, gene")
def _(spark, sf):
    _points, edges = spot_graph(spark, sf)
    return niche.aggregate(edges, views.counts(spark, sf)).select("id", "gene", _r("value"))


@register(
    "niche_hop_variance",
    _EXPR
    + " SELECT src AS id, gene, round(sum(value * value) / any_value(k) - (sum(value) / any_value(k)) * (sum(value) / any_value(k)), 6) AS value FROM e JOIN counts ON counts.id = dst JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) USING (src) GROUP BY src, gene",
)
def _(spark, sf):
    _points, edges = spot_graph(spark, sf)
    return niche.aggregate(edges, views.counts(spark, sf), "variance").select("id", "gene", _r("value"))


@register("niche_cellcharter")
def _(spark, sf):
    points, edges = spot_graph(spark, sf)
    return niche.calculate_niche("cellcharter", points, edges, views.counts(spark, sf), n_components=3, distance=2, min_size=3)


@register("niche_neighborhood")
def _(spark, sf):
    points, edges = lattice_graph(spark, sf)
    return niche.calculate_niche("neighborhood", points, edges, distance=1, min_size=5)


@register("niche_spatialleiden")
def _(spark, sf):
    points, edges = spot_graph(spark, sf)
    return niche.calculate_niche("spatialleiden", points, edges, latent=edges, layer_ratio=0.5)


@register(
    "niche_custom",
    LATTICE
    + """, own AS (SELECT id, lib % 4 AS grp, cl, lib FROM lattice), p AS (SELECT e.src AS id, d.cl, sum(w) AS n FROM e JOIN own d ON d.id = e.dst GROUP BY ALL),
 best AS (SELECT id, cl FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, cl) = 1), l AS (SELECT own.id, grp, CASE WHEN best.cl IS NULL OR own.id % 10 = 0 THEN 'not_a_niche' ELSE best.cl END AS label FROM own LEFT JOIN best ON best.id = own.id),
 z AS (SELECT *, count(*) OVER (PARTITION BY grp, label) AS n FROM l)
 SELECT id, concat('lib=', grp, '_', CASE WHEN n < 70 THEN 'not_a_niche' ELSE label END) AS label FROM z""",
)
def _(spark, sf):
    """Niches named after the commonest label around a cell, in four groups of libraries by themselves."""
    points, edges = lattice_graph(spark, sf)
    around = lambda nodes, own: niche.hop_profile(own, nodes, absolute=True)
    commonest = lambda rows: rows.groupBy("id").agg(F.min_by("cl", F.struct(-F.col("share"), F.col("cl"))).alias("label"))
    return niche.calculate_custom(points.withColumn("grp", F.col("lib") % 4), edges, around, commonest, library="grp", min_size=70, mask="id % 10 <> 0")


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    out = windows.run_once(spark, sf, "events.parquet", schema, "ts", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))
