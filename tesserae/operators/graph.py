"""Spatial neighbor graphs: ``points(lib, id, x, y)`` to ``edges(lib, src, dst, w, dist)``."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.rangejoin import near_pairs
from tesserae.session import materialise

EDGES = ["lib", "src", "dst", "w", "dist"]
#: Points between two looks for triangles that a sweep has passed.
SWEEP = 32
PostProcessor = Callable[[DataFrame, DataFrame], DataFrame]


def with_diagonal(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Adds a self-edge of weight 1 and distance 0 for every point."""
    loops = points.select("lib", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"), F.lit(0.0).alias("dist"))
    return edges.where("src <> dst").unionByName(loops)


def radius_edges(points: DataFrame, radius: float) -> DataFrame:
    p = points.select("lib", "id", "x", "y")
    pairs = near_pairs(p, p, radius).where("a_id <> b_id")
    return pairs.select("lib", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.lit(1.0).alias("w"), F.sqrt("d2").alias("dist"))


def knn_edges(points: DataFrame, k: int, queries: DataFrame | None = None, start: float | None = None) -> DataFrame:
    """The k nearest other points, ties by id.

    Points look in the cells around them; those whose k-th neighbor lies beyond the
    searched radius look again at twice the radius.  A library with too few points
    ends when the radius covers it.
    """
    p = points.select("lib", "id", "x", "y")
    left = p if queries is None else queries.select("lib", "id", "x", "y")
    box = p.groupBy("lib").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    whole = (p if queries is None else p.unionByName(left)).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    span = whole.crossJoin(box.agg(F.avg(F.sqrt(F.greatest(F.col("w") * F.col("h"), F.lit(1e-9)) * k / F.col("n"))).alias("r"))).first()
    if span["span"] is None:
        return radius_edges(p, 1.0)
    radius = float(start or max(span["r"] or 0.0, float(span["span"]) * 1e-3, 1e-6))
    done: DataFrame | None = None
    rank = Window.partitionBy("lib", "src").orderBy("d2", "dst")
    while True:
        last = radius >= 1.5 * float(span["span"]) + 1e-9
        found = near_pairs(left, p, radius).where("a_id <> b_id").select("lib", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d2")
        best = materialise(found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k), "knn")
        full = best.where(F.col("r") == k).select("lib", "src") if not last else None
        kept = best if last else best.join(full.hint("merge"), ["lib", "src"], "left_semi")
        made = kept.select("lib", "src", "dst", F.lit(1.0).alias("w"), F.sqrt("d2").alias("dist"))
        done = made if done is None else done.unionByName(made)
        if last:
            return done
        left = materialise(left.join(full.withColumnRenamed("src", "id").hint("merge"), ["lib", "id"], "left_anti"), "knn-left")
        if left.isEmpty():
            return done
        radius *= 2


def delaunay_triangles(xy: np.ndarray) -> np.ndarray:
    """Bowyer-Watson triangulation of distinct points; rows of three point numbers.

    Points come by x, so a triangle whose circle ends before the next one is done and is not
    looked at again: only those at the sweep's front are, some sqrt(n) of them.
    """
    n = len(xy)
    if n < 3:
        return np.empty((0, 3), int)
    low, high = xy.min(0), xy.max(0)
    mid, size = (low + high) / 2, max(float((high - low).max()), 1e-9) * 1000
    pts = np.vstack([xy, mid + [[-size, -size], [size, -size], [0, size]]])

    def circle(t: np.ndarray) -> np.ndarray:
        a, b, c = pts[t[:, 0]], pts[t[:, 1]], pts[t[:, 2]]
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d = np.where(d == 0, 1e-300, d)
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], 1)
        return np.column_stack([u + a, (u**2).sum(1)])

    tri = np.array([[n, n + 1, n + 2]])
    circ = circle(tri)
    done: list[np.ndarray] = []
    for step, i in enumerate(np.lexsort((xy[:, 1], xy[:, 0]))):
        if step % SWEEP == 0:  # with room for rounding
            passed = circ[:, 0] + np.sqrt(circ[:, 2]) * (1 + 1e-9) < pts[i, 0] - 1e-9 * (abs(pts[i, 0]) + np.abs(circ[:, 0]))
            done.append(tri[passed])
            tri, circ = tri[~passed], circ[~passed]
        hit = (pts[i, 0] - circ[:, 0]) ** 2 + (pts[i, 1] - circ[:, 1]) ** 2 < circ[:, 2]
        own = tri[hit]
        sides = np.concatenate([own[:, [0, 1]], own[:, [1, 2]], own[:, [2, 0]]])
        rim, count = np.unique(sides.min(1) * (n + 3) + sides.max(1), return_counts=True)
        rim = rim[count == 1]
        new = np.column_stack([rim // (n + 3), rim % (n + 3), np.full(len(rim), i)])
        tri, circ = np.concatenate([tri[~hit], new]), np.concatenate([circ[~hit], circle(new)])
    tri = np.concatenate([*done, tri])
    return tri[(tri < n).all(1)]


def _delaunay_group(rows: pd.DataFrame) -> pd.DataFrame:
    xy = rows[["x", "y"]].to_numpy(float)
    ids = rows["id"].to_numpy()
    tri = delaunay_triangles(xy)
    sides = np.unique(np.sort(np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), 1), axis=0) if len(tri) else np.empty((0, 2), int)
    sides = np.vstack([sides, sides[:, ::-1]])
    d = np.sqrt(((xy[sides[:, 0]] - xy[sides[:, 1]]) ** 2).sum(1))
    return pd.DataFrame({"lib": rows["lib"].iloc[0], "src": ids[sides[:, 0]], "dst": ids[sides[:, 1]], "w": 1.0, "dist": d})


def delaunay_edges(points: DataFrame) -> DataFrame:
    """Edges of the Delaunay triangulation of every library; a library is one task's group."""
    p = points.select("lib", "id", "x", "y")
    kinds = dict(p.dtypes)
    return p.groupBy("lib").applyInPandas(_delaunay_group, f"lib {kinds['lib']}, src {kinds['id']}, dst {kinds['id']}, w double, dist double")


def ring_edges(base: DataFrame, rings: int) -> DataFrame:
    """Hop distances up to ``rings`` over ``base``; the ring is the distance."""
    step = base.where("src <> dst").select("lib", "src", "dst").distinct()
    seen = step.withColumn("ring", F.lit(1))
    front = step
    for ring in range(2, rings + 1):
        ahead = front.join(step.select("lib", F.col("src").alias("dst"), F.col("dst").alias("to")), ["lib", "dst"])
        new = ahead.select("lib", "src", F.col("to").alias("dst")).where("src <> dst").distinct()
        front = materialise(new.join(seen, ["lib", "src", "dst"], "left_anti"), "ring")
        seen = seen.unionByName(front.withColumn("ring", F.lit(ring)))
    return seen.select("lib", "src", "dst", F.lit(1.0).alias("w"), F.col("ring").cast("double").alias("dist"))


def interval(low: float, high: float) -> PostProcessor:
    """Keeps edges whose distance lies in [low, high]; self-edges stay."""
    return lambda edges, _: edges.where(F.col("dist").between(low, high) | (F.col("src") == F.col("dst")))


def percentile(q: float) -> PostProcessor:
    """Drops edges longer than a percentile of a library's distances, zeros of the diagonal included."""

    def run(edges: DataFrame, points: DataFrame) -> DataFrame:
        zeros = points.select("lib", F.lit(0.0).alias("dist"))
        limit = edges.where("src <> dst").select("lib", "dist").unionByName(zeros).groupBy("lib").agg(F.percentile("dist", q / 100.0).alias("_limit"))
        return edges.join(limit, "lib").where(F.col("dist") <= F.col("_limit") + 1e-9).select(EDGES)

    return run


def spectral(edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Weights divided by the roots of both ends' column sums."""
    sums = edges.groupBy("lib", "dst").agg(F.sum("w").alias("s"))
    both = edges.join(sums.withColumnRenamed("s", "sd"), ["lib", "dst"], "left").join(sums.select("lib", F.col("dst").alias("src"), F.col("s").alias("ss")), ["lib", "src"], "left")
    return both.select("lib", "src", "dst", F.when((F.col("ss") > 0) & (F.col("sd") > 0), F.col("w") / F.sqrt(F.col("ss") * F.col("sd"))).otherwise(0.0).alias("w"), "dist")


def cosine(edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Cosine similarity of adjacency rows; the pattern widens to points with a common neighbor."""
    e = edges.where("w <> 0").select("lib", "src", "dst", "w")
    norm = e.groupBy("lib", "src").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    r = e.select("lib", F.col("src").alias("src2"), "dst", F.col("w").alias("w2"))
    dots = e.join(r, ["lib", "dst"]).groupBy("lib", "src", "src2").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
    out = dots.join(norm, ["lib", "src"]).join(norm.select("lib", F.col("src").alias("src2"), F.col("n").alias("n2")), ["lib", "src2"])
    return out.select("lib", "src", F.col("src2").alias("dst"), (F.col("dot") / (F.col("n") * F.col("n2"))).alias("w"), F.lit(None).cast("double").alias("dist"))


TRANSFORMS: dict[str, PostProcessor] = {"spectral": spectral, "cosine": cosine}


class GraphBuilder(ABC):
    """Builds edges, then applies post-processors in order; subclass it for other graphs."""

    def __init__(self, *, percentile_: float | None = None, transform: str | None = None, set_diag: bool = False, post: Sequence[PostProcessor] = ()):
        self.set_diag = set_diag
        self.post = [*post, *([percentile(percentile_)] if percentile_ is not None else []), *([TRANSFORMS[transform]] if transform else [])]

    @abstractmethod
    def build_edges(self, points: DataFrame) -> DataFrame: ...

    def params(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "post"}

    def build(self, points: DataFrame) -> DataFrame:
        edges = self.build_edges(points)
        if self.set_diag:
            edges = with_diagonal(edges, points)
        for step in self.post:
            edges = step(edges, points)
        return edges.select(EDGES)


class KNN(GraphBuilder):
    def __init__(self, n_neighs: int = 6, **options):
        super().__init__(**options)
        self.n_neighs = n_neighs

    def build_edges(self, points: DataFrame) -> DataFrame:
        return knn_edges(points, self.n_neighs)


class Radius(GraphBuilder):
    """All pairs within a radius; a pair of radii keeps the distances between them."""

    def __init__(self, radius: float | tuple[float, float], **options):
        band = sorted(radius) if isinstance(radius, tuple) else None
        super().__init__(post=[interval(*band)] if band else (), **options)
        self.radius = band[1] if band else radius

    def build_edges(self, points: DataFrame) -> DataFrame:
        return radius_edges(points, self.radius)


class Delaunay(GraphBuilder):
    def __init__(self, radius: float | tuple[float, float] | None = None, **options):
        band = (0.0, radius) if isinstance(radius, (int, float)) else sorted(radius) if radius else None
        super().__init__(post=[interval(*band)] if band else (), **options)

    def build_edges(self, points: DataFrame) -> DataFrame:
        return delaunay_edges(points)


class Grid(GraphBuilder):
    """Lattice neighbors by ring: near edges of the base graph, then hops over them."""

    def __init__(self, n_neighs: int = 6, n_rings: int = 1, delaunay: bool = False, **options):
        super().__init__(**options)
        self.n_neighs, self.n_rings, self.delaunay = n_neighs, n_rings, delaunay

    def build_edges(self, points: DataFrame) -> DataFrame:
        if self.delaunay:
            base = delaunay_edges(points)
        else:
            base = materialise(knn_edges(points, self.n_neighs), "grid-base")
            typical = base.groupBy("lib").agg(F.percentile("dist", 0.5).alias("m"))
            base = base.join(typical, "lib").where("dist < 1.3 * m").select(EDGES)
        if self.n_rings > 1:
            return ring_edges(materialise(base, "grid-base"), self.n_rings)
        return base.withColumn("dist", F.lit(1.0))


def spatial_neighbors(points: DataFrame, *, coord_type: str | None = None, n_neighs: int = 6, radius=None, delaunay: bool = False, n_rings: int = 1, percentile: float | None = None, transform: str | None = None, set_diag: bool = False) -> DataFrame:  # noqa: A002
    """One front door: grid before triangulation before radius before nearest neighbors."""
    rest = {"transform": transform, "set_diag": set_diag}
    if coord_type == "grid":
        if percentile is not None:
            raise ValueError("grids have no percentile")
        return Grid(n_neighs, n_rings, delaunay, **rest).build(points)
    rest["percentile_"] = percentile
    if delaunay:
        return Delaunay(radius, **rest).build(points)
    if radius is not None:
        return Radius(radius, **rest).build(points)
    return KNN(n_neighs, **rest).build(points)


def inside_polygon(x, y, polygon: Sequence[tuple[float, float]]):
    """Even-odd test of a point expression against a polygon given by its corners."""
    odd = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y0 == y1:
            continue
        crosses = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        odd = odd + crosses.cast("int")
    return odd % 2 == 1


def mask_edges(edges: DataFrame, points: DataFrame, polygon: Sequence[tuple[float, float]], negative: bool = False) -> DataFrame:
    """Edges whose segment lies in a polygon (or, with ``negative``, the others)."""
    a = points.select("lib", F.col("id").alias("src"), F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    b = points.select("lib", F.col("id").alias("dst"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    line = edges.join(a, ["lib", "src"]).join(b, ["lib", "dst"])
    x0, y0, x1, y1 = (F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    within = inside_polygon(x0, y0, polygon) & inside_polygon(x1, y1, polygon) & inside_polygon((x0 + x1) / 2, (y0 + y1) / 2, polygon)
    side = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    for (px, py), (qx, qy) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        p, q = (F.lit(float(px)), F.lit(float(py))), (F.lit(float(qx)), F.lit(float(qy)))
        cut = (side(x0, y0, x1, y1, *p) * side(x0, y0, x1, y1, *q) < 0) & (side(*p, *q, x0, y0) * side(*p, *q, x1, y1) < 0)
        within = within & ~cut
    return line.where(~within if negative else within).select(EDGES)
