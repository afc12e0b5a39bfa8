"""Point patterns: co-occurrence over distance, convex hulls and Ripley's functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.graph import knn_edges
from tesserae.operators.paircounts import pair_counts, thresholds


def distance_span(points: DataFrame) -> tuple[float, float]:
    """Ends of the default distances, from the points that lie extreme in x + y."""
    two = points.select("x", "y").orderBy(F.col("x") + F.col("y"), "x").limit(2).collect()
    top = points.select("x", "y").orderBy((F.col("x") + F.col("y")).desc(), "x").limit(1).collect()[0]
    gap = lambda a, b: math.dist((a["x"], a["y"]), (b["x"], b["y"]))
    return gap(two[0], two[-1]), gap(two[0], top) / 2


def co_occurrence(points: DataFrame, interval: int | Sequence[float] = 50, value: str = "cl") -> DataFrame:
    """``cluster_i, cluster_c, r, ratio``: p(i | c within r) / p(i) at growing distances.

    Ordered pairs of different points within the largest distance are binned by the
    first threshold that takes them, counted by cluster pair, and added up over bins.
    """
    edges = list(map(float, interval)) if not isinstance(interval, int) else np.linspace(*distance_span(points), interval).tolist()
    radii = edges[1:]
    rows = points.where(F.col(value).isNotNull()).select("id", "x", "y", F.col(value).alias("c"))
    n = pair_counts(rows, np.maximum.accumulate([r * r for r in radii]))
    labels = rows.select("c").distinct()
    steps = points.sparkSession.createDataFrame([(k, r) for k, r in enumerate(radii)], "k int, r double")
    grid = labels.select(F.col("c").alias("cluster_i")).crossJoin(labels.select(F.col("c").alias("cluster_c"))).crossJoin(F.broadcast(steps))  # clusters squared times bins
    up = Window.partitionBy("cluster_i", "cluster_c").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(n, ["cluster_i", "cluster_c", "k"], "left").withColumn("m", F.sum(F.coalesce("n", F.lit(0))).over(up))
    given = F.sum("m").over(Window.partitionBy("k", "cluster_c"))
    of_i = F.sum("m").over(Window.partitionBy("k", "cluster_i"))
    total = F.sum("m").over(Window.partitionBy("k"))
    return full.select("cluster_i", "cluster_c", "r", F.when((given > 0) & (of_i > 0), (F.col("m") / given) / (of_i / total)).otherwise(0.0).alias("ratio"))


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, without collinear ones."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = half(pts), half(pts[::-1])
    return np.array(low[:-1] + high[:-1])


def _hull_group(rows: pd.DataFrame) -> pd.DataFrame:
    h = hull(rows[["x", "y"]].to_numpy(float))
    return pd.DataFrame({"lib": rows["lib"].iloc[0], "corner": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})


def convex_hulls(points: DataFrame) -> DataFrame:
    """``lib, corner, x, y`` of each library's hull.

    Every batch of rows is first reduced to the hulls of its own libraries, so only
    possible corners are shuffled.
    """
    kind = dict(points.dtypes)["lib"]
    schema = f"lib {kind}, corner long, x double, y double"

    def reduce(batches):
        for rows in batches:
            parts = [_hull_group(g) for _, g in rows.groupby("lib")]
            if parts:
                yield pd.concat(parts)

    some = points.select("lib", "x", "y").mapInPandas(reduce, schema)
    return some.groupBy("lib").applyInPandas(_hull_group, schema)


def hull_areas(points: DataFrame) -> DataFrame:
    corners = convex_hulls(points)
    w = Window.partitionBy("lib").orderBy("corner")
    first = Window.partitionBy("lib").orderBy("corner").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(first)), F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    return corners.withColumn("t", F.col("x") * ny - nx * F.col("y")).groupBy("lib").agg((F.abs(F.sum("t")) / 2).alias("area"), F.count(F.lit(1)).alias("corners"))


def cumulative(distances: DataFrame, by: Sequence[str], support: Sequence[float]) -> DataFrame:
    """``bin, stat``: the share of in-range distances up to each value of ``support``; 0 at its start."""
    last = len(support) - 1
    step = (support[-1] - support[0]) / last
    inside = distances.where(F.col("d").between(support[0], support[-1]))
    k = F.least(F.floor((F.col("d") - support[0]) / step), F.lit(last - 1)) + 1
    n = inside.groupBy(*by, k.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    steps = distances.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(support)], "k int, bin double")
    grid = distances.select(*by).distinct().crossJoin(F.broadcast(steps))
    up = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(n, [*by, "k"], "left").withColumn("m", F.sum(F.coalesce("n", F.lit(0))).over(up))
    total = F.max("m").over(Window.partitionBy(*by))
    return full.select(*by, "bin", F.when(total > 0, F.col("m") / total).otherwise(0.0).alias("stat"))


def ripley_l(points: DataFrame, area: float, support: Sequence[float], value: str = "cl") -> DataFrame:
    """``cluster, bin, stat``: L(r) = sqrt(K(r) / pi) with the intensity of all points."""
    n = points.count()
    rows = points.select("id", "x", "y", F.col(value).alias("c"))
    step = (support[-1] - support[0]) / (len(support) - 1)
    limits = thresholds(lambda d2: np.ceil((np.sqrt(d2) - support[0]) / step - 1e-9), len(support), float(max(support)) ** 2)
    found = pair_counts(rows, limits, alike=True).select(F.col("cluster_i").alias("cluster"), "k", F.col("n").alias("m"))
    steps = points.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(support)], "k int, bin double")
    grid = rows.select(F.col("c").alias("cluster")).distinct().crossJoin(F.broadcast(steps))
    up = Window.partitionBy("cluster").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(found, ["cluster", "k"], "left").withColumn("m", F.sum(F.coalesce("m", F.lit(0))).over(up))
    return full.select("cluster", "bin", F.sqrt(F.col("m") / n / (n / area) / math.pi).alias("stat"))


def ripley_g(points: DataFrame, support: Sequence[float], n_neigh: int = 2, value: str = "cl") -> DataFrame:
    """``cluster, bin, stat`` of distances from points of other clusters to the nearest of a cluster."""
    rows = points.select("id", "x", "y", F.col(value).alias("c"))
    labels = rows.select(F.col("c").alias("lib")).distinct()
    asked = rows.join(labels, F.col("c") != F.col("lib")).select("lib", "id", "x", "y")
    near = knn_edges(rows.select(F.col("c").alias("lib"), "id", "x", "y"), n_neigh, queries=asked)
    return cumulative(near.select(F.col("lib").alias("cluster"), F.col("dist").alias("d")), ["cluster"], support)


def poisson_points(corners: Sequence[tuple[float, float]], n_sims: int, n_points: int, spark, seed: int = 0) -> DataFrame:
    """``sim, id, x, y``: uniform points of a convex polygon, drawn by rejection until every pattern has ``n_points``.

    Places are hashes of seed and number, so they don't depend on partitioning.  A polygon
    without area raises.
    """
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = (max(xs) - min(xs)) * (max(ys) - min(ys))
    area = abs(sum(xs[i] * ys[(i + 1) % len(xs)] - xs[(i + 1) % len(xs)] * ys[i] for i in range(len(xs)))) / 2
    if area <= 0:
        raise ValueError("the points span no area")
    unit = lambda axis: F.xxhash64(F.lit(seed), F.lit(axis), "id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    ok = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        ok = ok & ((bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax) >= 0)
    tries = int(n_points * box / area * 1.5) + 64
    while True:
        raw = spark.range(n_sims * tries).select((F.col("id") % n_sims).alias("sim"), F.col("id"), (min(xs) + unit("x") * (max(xs) - min(xs))).alias("x"), (min(ys) + unit("y") * (max(ys) - min(ys))).alias("y"))
        if raw.where(ok).groupBy("sim").count().where(F.col("count") >= n_points).count() == n_sims:
            break
        tries *= 2
    return raw.where(ok).withColumn("r", F.row_number().over(Window.partitionBy("sim").orderBy("id"))).where(F.col("r") <= n_points).drop("r")


def ripley_f(points: DataFrame, probes: DataFrame, support: Sequence[float], value: str = "cl") -> DataFrame:
    """``cluster, bin, stat`` of distances from probe points (``id, x, y``) to the nearest of each cluster."""
    labels = points.select(F.col(value).alias("lib")).distinct()
    asked = labels.crossJoin(probes.select((-1 - F.col("id")).alias("id"), "x", "y"))  # clusters times the probes asked for
    near = knn_edges(points.select(F.col(value).alias("lib"), "id", "x", "y"), 1, queries=asked)
    return cumulative(near.select(F.col("lib").alias("cluster"), F.col("dist").alias("d")), ["cluster"], support)


def ripley(points: DataFrame, mode: str = "L", n_sims: int = 100, n_points: int = 1000, n_steps: int = 50, max_dist: float | None = None, seed: int = 0, value: str = "cl", n_neigh: int = 2) -> DataFrame:
    """``cluster, bin, stat, pvalue``; p from simulated Poisson patterns in the hull."""
    one = points.select(F.lit(0).alias("lib"), "x", "y")
    corners = [(r["x"], r["y"]) for r in convex_hulls(one).orderBy("corner").collect()]
    area = hull_areas(one).first()["area"]
    support = np.linspace(0, max_dist or math.sqrt(area / 2), n_steps).tolist()
    sims = poisson_points(corners, n_sims, n_points, points.sparkSession, seed).withColumn("c", F.col("sim"))
    if mode == "L":
        stat = ripley_l(points, area, support, value)
        own = ripley_l(sims.select("id", "x", "y", "c"), area, support, "c")
        own = own.withColumn("stat", F.col("stat") * n_sims)  # each simulation has its own points and intensity
    elif mode in ("F", "G"):
        probes = poisson_points(corners, 1, n_points, points.sparkSession, seed + 7)
        stat = ripley_f(points, probes, support, value) if mode == "F" else ripley_g(points, support, n_neigh, value)
        own = ripley_f(sims.select("id", "x", "y", "c"), probes, support, "c") if mode == "F" else cumulative(knn_edges(sims.select(F.col("c").alias("lib"), "id", "x", "y"), 1).select(F.col("lib").alias("cluster"), F.col("dist").alias("d")), ["cluster"], support)
    else:
        raise ValueError("mode must be F, G or L")
    over = stat.join(own.select("bin", F.col("stat").alias("sim")), "bin").groupBy("cluster", "bin", "stat").agg(F.sum((F.col("sim") >= F.col("stat")).cast("int")).alias("c"))
    p = (F.col("c") + 1) / F.lit(n_sims + 1.0)
    return over.select("cluster", "bin", "stat", F.least(p, 1 - p).alias("pvalue"))
