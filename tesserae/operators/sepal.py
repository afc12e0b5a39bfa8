"""Diffusion scores: how long a feature takes to spread evenly over a lattice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import radius_edges

#: Features of a library that one task diffuses together, as columns of one matrix.
FEATURES = 32


class Lattice:
    """Who gives to whom: cells with all neighbors, and the others with the one that each copies."""

    def __init__(self, cells: pd.DataFrame, degree: int):
        place = pd.Series(np.arange(len(cells)), index=cells["id"])
        near = [[] if n is None else place[list(n)].tolist() for n in cells["near"]]
        whole = np.array([len(n) == degree for n in near], bool)
        self.degree, self.inside, self.outside = degree, np.flatnonzero(whole), np.flatnonzero(~whole)
        self.near = np.array([near[i] for i in self.inside], int).reshape(-1, degree)
        xy = cells[["x", "y"]].to_numpy(float)

        def model(i: int) -> int:
            beside = [j for j in near[i] if whole[j]]
            return beside[0] if beside else self.inside[np.abs(xy[self.inside] - xy[i]).sum(1).argmin()]

        self.models = np.array([model(i) for i in self.outside], int) if len(self.inside) else np.empty(0, int)

    def flow(self, level: np.ndarray) -> np.ndarray:
        """What each cell gains in a unit of time: the discrete Laplacian of a square or hexagonal lattice."""
        out = np.empty_like(level)
        scale = 2 / 3 if self.degree == 6 else 1.0
        out[self.inside] = scale * (level[self.near].sum(axis=1) - self.degree * level[self.inside])
        out[self.outside] = out[self.models]
        return out


def evenness(level: np.ndarray) -> np.ndarray:
    """Entropy of every column's shares: log S - sum(x log x) / S for its sum S; 0 for an empty column."""
    total = level.sum(axis=0)
    some = total > 0
    logs = (level * np.log(np.where(level > 0, level, 1.0))).sum(axis=0)
    return np.where(some, np.log(np.where(some, total, 1.0)) - logs / np.where(some, total, 1.0), 0.0)


def diffusion_times(lattice: Lattice, values: np.ndarray, n_iter: int, dt: float, thresh: float) -> np.ndarray:
    """For every column, the time until a step changes its entropy per inside cell by ``thresh`` at most; NaN if none does."""
    times = np.full(values.shape[1], np.nan)
    if not len(lattice.inside):
        return times
    level, open_ = values.astype(float), np.arange(values.shape[1])
    before = np.ones(len(open_))
    for step in range(n_iter):
        level = np.maximum(level + dt * lattice.flow(level), 0)
        now = evenness(level[lattice.inside]) / len(lattice.inside)
        settled = np.abs(now - before) <= thresh
        before = now
        if settled.any():
            times[open_[settled]] = dt * step
            level, open_, before = level[:, ~settled], open_[~settled], now[~settled]
            if not len(open_):
                break
    return times


def sepal(points: DataFrame, expr: DataFrame, max_neighs: int = 6, radius: float = 1.01, n_iter: int = 30_000, dt: float = 0.001, thresh: float = 1e-8) -> DataFrame:
    """``lib, gene, score`` for every feature in every library.

    A task holds the lattice of one library, which diffusion needs whole, and ``FEATURES``
    features of it; only values that are there travel.
    """
    if max_neighs not in (4, 6):
        raise ValueError("max_neighs must be 4 or 6")
    edges = radius_edges(points, radius)
    near = edges.groupBy("lib", F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    cells = points.select("lib", "id", "x", "y").join(near, ["lib", "id"], "left")
    genes = expr.select("gene").distinct()
    batches = F.greatest(F.lit(1), F.ceil(F.col("genes") / FEATURES)).cast("int")
    count = F.broadcast(genes.agg(F.count(F.lit(1)).alias("genes")).select(batches.alias("batches")))  # one row
    batch = F.pmod(F.xxhash64("gene"), F.col("batches")).cast("int").alias("batch")
    libraries = points.select("lib").distinct()
    # Every feature is scored in every library, with or without values there.
    named = libraries.crossJoin(F.broadcast(genes)).crossJoin(count).select("lib", batch, "gene")
    spread = cells.crossJoin(count).select("lib", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "id", "x", "y", "near")
    there = expr.select("id", "gene", "value").join(points.select("lib", "id"), "id").crossJoin(count).select("lib", batch, "gene", "id", "value")
    none = dict(points.dtypes)["id"]
    values = there.unionByName(named.withColumns({"id": F.lit(None).cast(none), "value": F.lit(None).cast("double")}))
    values = values.select(F.col("lib").alias("_lib"), F.col("batch").alias("_batch"), "gene", "id", "value")
    kind = dict(points.dtypes)["lib"]

    def run(lattice: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if lattice.empty or found.empty:
            return pd.DataFrame({"lib": [], "gene": [], "score": []})
        lattice = lattice.sort_values("id").reset_index(drop=True)
        names = sorted(found["gene"].unique())
        found = found.dropna(subset=["value"])
        matrix = np.zeros((len(lattice), len(names)))
        rows = pd.Index(lattice["id"]).get_indexer(found["id"].astype(lattice["id"].dtype))
        np.add.at(matrix, (rows, pd.Index(names).get_indexer(found["gene"])), found["value"].to_numpy(float))
        times = diffusion_times(Lattice(lattice, max_neighs), matrix, n_iter, dt, thresh)
        return pd.DataFrame({"lib": lattice["lib"].iloc[0], "gene": names, "score": times})

    return spread.groupBy("lib", "batch").cogroup(values.groupBy("_lib", "_batch")).applyInPandas(run, f"lib {kind}, gene string, score double")
