"""Niches: neighborhood profiles, aggregated features and clusters of cells."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.leiden import communities
from tesserae.session import materialise

#: Cells that the search for near vectors deals to at most, and values that its pivots hold in all.
MAX_PIVOTS, MAX_PIVOT_VALUES = 4096, 4_000_000
#: Vectors that visit a cell in one task.
MAX_VISITS = 65_536


def next_hop(front: DataFrame, edges: DataFrame) -> DataFrame:
    """Path weights one hop further: the product of two adjacency matrices."""
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("v"))
    return front.join(step, "dst").groupBy("src", "to").agg(F.sum(F.col("w") * F.col("v")).alias("w")).withColumnRenamed("to", "dst").select("src", "dst", "w")


def hop_profile(edges: DataFrame, nodes: DataFrame, value: str = "cl", absolute: bool = False) -> DataFrame:
    """``id, cl, share``: weight (or share of it) that a node's edges give to each label."""
    labels = nodes.select(F.col("id").alias("dst"), F.col(value).alias("cl")).where("cl is not null")
    n = edges.join(labels, "dst").groupBy(F.col("src").alias("id"), "cl").agg(F.sum("w").alias("n"))
    if absolute:
        return n.withColumnRenamed("n", "share")
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("id"))).drop("n")


def neighborhood_profile(edges: DataFrame, nodes: DataFrame, value: str = "cl", distance: int = 1, weights: Sequence[float] | None = None, absolute: bool = False, scale: bool = False) -> DataFrame:
    """``id, cl, value`` over 1 to ``distance`` hops; a hop's weight is repeated when too few are given."""
    given = list(weights or [1.0])
    given += [given[-1]] * (distance - len(given))
    unit = edges.select("src", "dst", F.lit(1.0).alias("w"))
    hop, parts = unit, None
    for k in range(distance):
        if k:
            hop = materialise(next_hop(hop, unit), "hop")
        part = hop_profile(hop, nodes, value, absolute).select("id", "cl", (F.col("share") * given[k]).alias("v"))
        parts = part if parts is None else parts.unionByName(part)
    total = 1.0 if absolute else float(sum(given[:distance]))
    grid = nodes.select("id").crossJoin(F.broadcast(nodes.select(F.col(value).alias("cl")).where("cl is not null").distinct()))  # a row for each cell and label
    sums = parts.groupBy("id", "cl").agg((F.sum("v") / total).alias("value"))
    out = grid.join(sums, ["id", "cl"], "left").na.fill(0.0, ["value"])
    if scale:
        m = out.groupBy("cl").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
        out = out.join(F.broadcast(m), "cl").select("id", "cl", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0).alias("value"))
    return out


def visited_hops(edges: DataFrame, distance: int, strict: bool = False) -> list[DataFrame]:
    """Adjacency of hops 0 to ``distance``.

    A pair belongs to the next hop where its path weight exceeds its count of earlier
    visits; with ``strict``, where it was not visited.
    """
    unit = edges.where("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))
    loops = edges.select("src").union(edges.select("dst")).distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    hops = [loops, unit]
    seen = unit.union(loops).groupBy("src", "dst").agg(F.sum("w").alias("v"))
    front = unit
    for _ in range(2, distance + 1):
        ahead = next_hop(front, unit)
        new = ahead.join(seen, ["src", "dst"], "left").where(F.col("v").isNull() if strict else F.col("w") > F.coalesce("v", F.lit(0.0)))
        front = materialise(new.select("src", "dst", F.lit(1.0).alias("w")), "hop")
        seen = materialise(seen.select("src", "dst", F.col("v").alias("w")).union(front).groupBy("src", "dst").agg(F.sum("w").alias("v")), "seen")
        hops.append(front)
    return hops[: distance + 1]


def aggregate(edges: DataFrame, expr: DataFrame, how: str = "mean") -> DataFrame:
    """``id, gene, value``: mean or variance of a feature over a node's neighbors; absent values are zeros."""
    total = edges.groupBy("src").agg(F.sum("w").alias("t"))
    x = expr.select(F.col("id").alias("dst"), "gene", "value")
    sums = edges.join(x, "dst").groupBy("src", "gene").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("q")).join(total, "src")
    mean = F.col("s") / F.col("t")
    value = mean if how == "mean" else F.col("q") / F.col("t") - mean * mean
    return sums.where("t <> 0").select(F.col("src").alias("id"), "gene", value.alias("value"))


def hop_features(edges: DataFrame, expr: DataFrame, distance: int = 3, how: str = "mean") -> DataFrame:
    """``id, gene, value`` with features of each hop side by side (``gene@hop``)."""
    parts = []
    for k, hop in enumerate(visited_hops(edges, distance)):
        own = expr.select("id", "gene", "value") if k == 0 else aggregate(hop, expr, how)
        parts.append(own.withColumn("gene", F.concat("gene", F.lit(f"@{k}"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def as_vectors(long: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, features``: long rows as vectors, absent ones zero, features in order of name."""
    names = sorted(r["gene"] for r in long.select("gene").distinct().collect())
    wide = long.groupBy("id").pivot("gene", names).agg(F.first("value")).na.fill(0.0)
    every = nodes.select("id").join(wide, "id", "left").na.fill(0.0)
    return every.select("id", array_to_vector(F.array(*[F.col(f"`{n}`") for n in names])).alias("features"))


def embed(vectors: DataFrame, k: int) -> DataFrame:
    """Principal components of the vectors."""
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(vectors)
    return model.transform(vectors).select("id", F.col("pca").alias("features"))


def mixture(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    model = GaussianMixture(k=k, seed=seed).fit(vectors)
    return model.transform(vectors).select("id", F.concat(F.lit("niche_"), F.col("prediction")).alias("label"))


def finish(labels: DataFrame, nodes: DataFrame, min_size: int | None = None, mask: str | None = None, prefix: str | None = None) -> DataFrame:
    """Marks masked cells and small niches as ``not_a_niche``, then prefixes labels."""
    out = nodes.select("id", *([F.expr(mask).alias("_keep")] if mask else [F.lit(True).alias("_keep")])).join(labels, "id", "left")
    label = F.when(~F.col("_keep") | F.col("label").isNull(), F.lit("not_a_niche")).otherwise(F.col("label").cast("string"))
    out = out.withColumn("label", label)
    if min_size:
        out = out.withColumn("label", F.when(F.count(F.lit(1)).over(Window.partitionBy("label")) < min_size, F.lit("not_a_niche")).otherwise(F.col("label")))
    return out.select("id", (F.concat(F.lit(prefix), "label") if prefix else F.col("label")).alias("label"))


#: What each flavor reads beside cells and edges, and the options that it uses.
FLAVORS: dict[str, tuple[set[str], set[str]]] = {
    "neighborhood": (set(), {"value", "distance", "weights", "absolute", "scale", "resolution"}),
    "utag": ({"expr"}, {"resolution"}),
    "cellcharter": ({"expr"}, {"n_components", "distance", "aggregation", "random_state"}),
    "spatialleiden": ({"latent"}, {"layer_ratio", "resolution"}),
}
COMMON = {"min_size", "mask", "prefix"}


def check_arguments(flavor: str, tables: dict[str, DataFrame | None], options: dict) -> dict:
    """The options that a flavor uses; raises for what is missing or out of range and warns of what is unused."""
    if flavor not in FLAVORS:
        raise ValueError(f"unknown flavor {flavor}")
    needed, used = FLAVORS[flavor]
    missing = sorted(t for t in needed if tables.get(t) is None)
    if missing:
        raise ValueError(f"{flavor} needs {missing}")
    known = COMMON.union(*[u for _, u in FLAVORS.values()])
    unknown = sorted(options.keys() - known)
    if unknown:
        raise TypeError(f"unknown options: {unknown}")
    for name, least in (("distance", 1), ("n_components", 1), ("min_size", 0)):
        v = options.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < least):
            raise ValueError(f"{name} must be a whole number from {least}")
    for name in ("resolution", "layer_ratio"):
        if name in options and not options[name] > 0:
            raise ValueError(f"{name} must be above zero")
    if options.get("aggregation", "mean") not in ("mean", "variance"):
        raise ValueError("aggregation is mean or variance")
    unused = sorted([t for t, v in tables.items() if v is not None and t not in needed] + [o for o in options if o not in used | COMMON])
    if unused:
        warnings.warn(f"{flavor} does not use {unused}", stacklevel=3)
    return {k: v for k, v in options.items() if k in used | COMMON}


def calculate_custom(
    nodes: DataFrame,
    edges: DataFrame,
    embedder: Callable[[DataFrame, DataFrame], DataFrame],
    clusterer: Callable[[DataFrame], DataFrame],
    library: str | None = None,
    min_size: int | None = None,
    mask: str | None = None,
) -> DataFrame:
    """``id, label`` by any embedding and any clustering.

    ``embedder`` gets cells and edges, ``clusterer`` gets its result and returns ``id, label``.  With ``library``, a
    column of ``nodes``, each of its values is worked on by itself, with edges inside it only, and its labels
    start with ``lib=``, the value and ``_``; cells without one are no niche.
    """
    one = lambda part, inside, prefix: finish(clusterer(embedder(part, inside)), part, min_size, mask, prefix)
    if library is None:
        return one(nodes, edges, None)
    own = nodes.select("id", F.col(library).alias("_lib"))
    ends = edges.join(own.withColumnsRenamed({"id": "src"}), "src").join(own.withColumnsRenamed({"id": "dst", "_lib": "_to"}), "dst").where("_lib = _to").drop("_to")
    inside = materialise(ends.select(*edges.columns, "_lib"), "library-edges")
    out = nodes.where(F.col(library).isNull()).select("id", F.lit("not_a_niche").alias("label"))
    for name in sorted(r["_lib"] for r in own.where("_lib is not null").select("_lib").distinct().collect()):  # a row for each library
        out = out.unionByName(one(nodes.where(F.col(library) == name), inside.where(F.col("_lib") == name).drop("_lib"), f"lib={name}_"))
    return out


def calculate_niche(flavor: str, nodes: DataFrame, edges: DataFrame, expr: DataFrame | None = None, latent: DataFrame | None = None, **options) -> DataFrame:
    """``id, label`` by one of the flavors neighborhood, utag, cellcharter and spatialleiden."""
    options = check_arguments(flavor, {"expr": expr, "latent": latent}, options)
    post = {k: options.pop(k) for k in ("min_size", "mask", "prefix") if k in options}
    resolution = options.pop("resolution", 1.0)
    if flavor == "cellcharter":
        k = options.pop("n_components", 10)
        features = hop_features(edges, expr, options.pop("distance", 3), options.pop("aggregation", "mean"))
        return finish(mixture(embed(as_vectors(features, nodes), min(k, 10)), k, options.pop("random_state", 42)), nodes, **post)
    if flavor == "neighborhood":
        rows = neighborhood_profile(edges, nodes, **options).select("id", F.col("cl").alias("gene"), "value")
    elif flavor == "utag":
        rows = aggregate(edges, expr)
    else:
        ratio = options.pop("layer_ratio", 1.0)
        both = edges.select("src", "dst", (F.col("w") * ratio).alias("w")).union(latent.select("src", "dst", "w"))
        return finish(communities(both, resolution), nodes, **post)
    return finish(communities(feature_neighbors(as_vectors(rows, nodes)), resolution), nodes, **post)


def feature_neighbors(vectors: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` nearest vectors of each, by distance and then id, after scaling: ``src, dst, w``.

    Equal vectors are searched once.  Distinct ones are dealt to the nearest of some pivots;
    the search in the own cell bounds the k-th distance, and then each vector visits every
    other cell that the triangle inequality does not rule out, so the result is exact.
    """
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(vectors).transform(vectors).select("id", vector_to_array("z").alias("v"))
    cells = materialise(scaled.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "scaled")  # no negative zeros
    order = Window.partitionBy("v").orderBy("id")
    first = cells.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    groups = materialise(first.groupBy("v").agg(F.min("id").alias("g"), F.sort_array(F.collect_list("id")).alias("ids")), "groups")
    n = groups.count()
    if not n:
        return cells.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    width = len(groups.first()["v"])
    some = max(1, min(int(n**0.5), MAX_PIVOTS, MAX_PIVOT_VALUES // max(width, 1)))
    pivots = np.array([r["v"] for r in groups.orderBy(F.xxhash64("v"), "g").limit(some).select("v").collect()], float).reshape(-1, width)
    kind = dict(cells.dtypes)["id"]
    group = f"g {kind}, v array<double>, ids array<{kind}>, cell int"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = np.array(rows["v"].tolist(), float).reshape(-1, width)
            d = np.concatenate([_squares(v[a:b], pivots) for a, b in _blocks(len(v), len(pivots))]) if len(v) else np.empty((0, len(pivots)))
            yield rows.assign(cell=d.argmin(1).astype("int32"), far=np.sqrt(d.min(1)))

    dealt = materialise(groups.mapInPandas(deal, f"{group}, far double"), "dealt")
    radius = np.full(len(pivots), -np.inf)
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each pivot
        radius[r["cell"]] = r["far"]

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        out = _ranked(rows, rows, k)
        bound = [found[-1][0] if len(found) > k else float("inf") for found in out]
        return rows[["g", "v", "cell"]].assign(bound=bound, found=[[{"d": d, "id": i} for d, i in found] for found in out])

    found = f"array<struct<d: double, id: {kind}>>"
    own = materialise(dealt.drop("far").groupBy("cell").applyInPandas(lambda rows: within(rows), f"g {kind}, v array<double>, cell int, bound double, found {found}"), "own")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = np.array(rows["v"].tolist(), float).reshape(-1, width)
            bound, home = np.sqrt(rows["bound"].to_numpy(float)), rows["cell"].to_numpy()
            for a, b in _blocks(len(v), len(pivots)):
                gap = np.sqrt(_squares(v[a:b], pivots)) - radius
                # A little more than the bound, so that ties and rounding lose nothing.
                near = gap <= (bound[a:b] * (1 + 1e-9) + 1e-9)[:, None]
                near[np.arange(b - a), home[a:b]] = False
                i, c = np.nonzero(near)
                yield pd.DataFrame({"g": rows["g"].to_numpy()[a:b][i], "v": rows["v"].to_numpy()[a:b][i], "cell": c.astype("int32")})

    def elsewhere(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = _ranked(asked, rows, k) if len(asked) and len(rows) else []
        return pd.DataFrame({"g": asked["g"].to_numpy()[: len(out)] if len(rows) else [], "found": [[{"d": d, "id": i} for d, i in found] for found in out]})

    asked = materialise(own.select("g", "v", "cell", "bound").mapInPandas(visits, f"g {kind}, v array<double>, cell int"), "asked")
    # A cell that many vectors visit is searched in several tasks; a row for each pivot at most.
    parts = F.broadcast(asked.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / MAX_VISITS) + 1).cast("int").alias("n")))
    dealt_asked = asked.join(parts, "cell").select("g", "v", "cell", F.pmod(F.xxhash64("g"), F.col("n")).cast("int").alias("part"))
    visited = dealt.drop("far").join(parts, "cell").select("g", "v", "ids", "cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    others = dealt_asked.groupBy("cell", "part").cogroup(visited.groupBy("cell", "part")).applyInPandas(lambda a, b: elsewhere(a, b), f"g {kind}, found {found}")
    merged = own.select("g", "found").union(others).groupBy("g").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("best"))
    member = cells.join(groups.select("v", "g"), "v").select("id", "g")
    near = member.join(merged, "g").select(F.col("id").alias("src"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return near.select("src", F.explode("best").alias("o")).select("src", F.col("o.id").alias("dst"), (1 / (1 + F.sqrt("o.d"))).alias("w"))


def _blocks(rows: int, columns: int) -> list[tuple[int, int]]:
    """Ranges of rows whose matrix of distances stays small."""
    step = max(1, 2_000_000 // max(columns, 1))
    return [(a, min(a + step, rows)) for a in range(0, rows, step)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, summed in order of the columns."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _ranked(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[list[tuple[float, int]]]:
    """For each asked vector its ``k`` + 1 nearest members of ``rows``: (squared distance, id) in order."""
    a, b = (np.array(x["v"].tolist(), float).reshape(len(x), -1) for x in (asked, rows))
    ids = list(rows["ids"])
    out = []
    for lo, hi in _blocks(len(a), len(b)):
        d = _squares(a[lo:hi], b)
        last = np.partition(d, k, axis=1)[:, k] if len(b) > k + 1 else np.full(hi - lo, np.inf)
        for own, edge in zip(d, last, strict=True):
            some = np.nonzero(own <= edge)[0]  # every vector has a member, so k + 1 vectors are enough, with all ties
            out.append(sorted((float(own[i]), m) for i in some for m in ids[i])[: k + 1])
    return out
