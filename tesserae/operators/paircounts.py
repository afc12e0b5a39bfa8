"""Numbers of pairs of points by distance, counted inside tasks and never made into rows.

Points lie in square cells as wide as the largest distance.  The points of a cell meet
those of its own and of half of the cells around it, a block of at most ``BLOCK`` against another at a time;
only counts leave a task.  So memory is bounded by the blocks and by the square of the
number of labels, and the pairs, whose number grows with the square of the density, cost time alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a cell that meet at once; more are dealt into blocks.
BLOCK = 8192
#: Cells that a cell's points visit: itself, and one of each two opposite ones around it.
AHEAD = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
_ROWS, _COLUMNS = 128, 2048


def thresholds(place: Callable[[np.ndarray], np.ndarray], bins: int, top: float) -> np.ndarray:
    """For each bin the largest squared distance up to ``top`` whose place is in it or before, -1 for none.

    ``place`` rises with the squared distance; the border is found to the last bit.
    """
    out = np.full(bins, -1.0)
    for k in range(bins):
        low, high = 0, int(np.float64(top).view(np.int64))
        if place(np.float64(0.0)) > k:
            continue
        while low < high:  # doubles above 0 are ordered as their bits are
            middle = (low + high + 1) // 2
            low, high = (middle, high) if place(np.int64(middle).view(np.float64)) <= k else (low, middle - 1)
        out[k] = np.int64(low).view(np.float64)
    return out


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _between(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], limits: np.ndarray, labels: int) -> np.ndarray:
    """``[label of a, label of b, k]``: pairs within each of the rising limits; both sides are sorted by label."""
    (ax, ay, ac), (bx, by, bc) = a, b
    out = np.zeros((labels, labels, len(limits)), np.int64)
    for low in range(0, len(bx), _COLUMNS):
        x, y, c = bx[low : low + _COLUMNS], by[low : low + _COLUMNS], bc[low : low + _COLUMNS]
        at = _starts(c)
        for begin, end in zip(s := _starts(ac), [*s[1:], len(ac)], strict=True):
            for i in range(begin, end, _ROWS):
                rows = slice(i, min(i + _ROWS, end))
                dx, dy = ax[rows, None] - x, ay[rows, None] - y
                dx *= dx
                dy *= dy
                dx += dy
                for k, limit in enumerate(limits):
                    near = np.add.reduce((dx <= limit).view(np.uint8), axis=0, dtype=np.uint8)  # at most _ROWS
                    out[ac[begin], c[at], k] += np.add.reduceat(near.astype(np.int64), at)
    return out


def _alike(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], limits: np.ndarray, labels: int) -> np.ndarray:
    """``[label, k]``: the same of pairs with one label on both sides, for many limits."""
    (ax, ay, ac), (bx, by, bc) = a, b
    out = np.zeros((labels, len(limits)), np.int64)
    top = limits[-1]
    # Parts of equal width tell nearly where a pair falls; the limits beside it settle it.
    steps = len(limits) * 8
    parts = np.searchsorted(limits, (np.arange(steps + 1) / steps) ** 2 * top)
    even = np.diff(parts).max() <= 1
    for c in range(labels):
        p, q = slice(*np.searchsorted(ac, [c, c + 1])), slice(*np.searchsorted(bc, [c, c + 1]))
        x, y = bx[q], by[q]
        for i in range(p.start, p.stop, _ROWS):
            for low in range(0, len(x), _COLUMNS):
                rows = slice(i, min(i + _ROWS, p.stop))
                dx, dy = ax[rows, None] - x[low : low + _COLUMNS], ay[rows, None] - y[low : low + _COLUMNS]
                dx *= dx
                dy *= dy
                dx += dy
                if len(limits) <= 6:
                    out[c] += [np.count_nonzero(dx <= limit) for limit in limits]
                    continue
                d = dx[dx <= top]
                if even:
                    k = parts[(np.sqrt(d / top) * steps).astype(np.intp)]
                    k -= (k > 0) & (d <= limits[k - 1])
                    k += d > limits[k]
                else:
                    k = np.searchsorted(limits, d)
                out[c] += np.cumsum(np.bincount(k, minlength=len(limits)))
    return out


def pair_counts(points: DataFrame, limits: Sequence[float], alike: bool = False) -> DataFrame:
    """``cluster_i, cluster_c, k, n`` of ``points(id, x, y, c)``: ordered pairs by the first limit that takes their squared distance.

    Limits don't fall.  Pairs of one id don't count; ``alike`` counts only those of one label.
    """
    wide = np.asarray(limits, float)
    radius = float(np.sqrt(max(wide[-1], 0.0))) * (1 + 1e-12) or 1.0
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    at = ["deal", "gx", "gy"]
    here = points.select("id", "x", "y", "c", cell("x").alias("gx"), cell("y").alias("gy")).where("x is not null and y is not null and c is not null")
    deals = 1
    if alike:  # labels that never meet part where cells are large
        most = here.groupBy("gx", "gy").count().agg(F.max("count").alias("n")).first()["n"]
        deals = -(-(most or 1) // BLOCK)
    here = here.withColumn("deal", F.pmod(F.xxhash64("c"), F.lit(deals)).cast("int") if deals > 1 else F.lit(0))
    sizes = here.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = here.join(sizes.hint("merge"), at)
    right = known.withColumnRenamed("parts", "own").withColumn("q", deal("own"))
    # A cell's points meet every block of the cells they visit, a block of theirs at a time.
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AHEAD]))
    left = known.withColumnRenamed("parts", "own").withColumn("p", deal("own")).withColumn("to", to)
    left = left.withColumns({"gx": F.col("gx") + F.col("to.i"), "gy": F.col("gy") + F.col("to.j"), "way": F.col("to.i") * 3 + F.col("to.j")}).drop("to", "own")
    left = left.join(sizes.hint("merge"), at).withColumn("q", every("parts"))
    left = left.select(*at, "p", "q", "way", "id", "x", "y", "c", F.lit(0).alias("side"))
    tasks = left.select(*at, "p", "q").distinct()
    right = right.select(*at, "q", F.lit(9).alias("way"), "id", "x", "y", "c", F.lit(1).alias("side")).join(tasks.hint("merge"), [*at, "q"])
    both = left.unionByName(right.select(*left.columns))

    def run(group: pa.Table) -> pa.Table:
        import pandas as pd

        rows = group.select(["way", "id", "x", "y", "c", "side"]).to_pandas()
        names, codes = np.unique(rows["c"].to_numpy(), return_inverse=True)
        rows["c"] = codes
        rows = rows.sort_values("c", kind="stable")
        sides = rows["side"].to_numpy()
        other = rows[sides == 1]
        n = len(names)
        total = np.zeros((n, len(wide)) if alike else (n, n, len(wide)), np.int64)
        arrays = lambda t: tuple(t[k].to_numpy() for k in ("x", "y", "c"))
        for inside in (True, False):
            own = rows[(sides == 0) & ((rows["way"].to_numpy() == 0) == inside)]
            if not len(own) or not len(other):
                continue
            found = (_alike if alike else _between)(arrays(own), arrays(other), wide, n)
            same = own.merge(other, on="id")
            if alike:
                same = same[same["c_x"] == same["c_y"]]
            d2 = (same["x_x"] - same["x_y"]).to_numpy() ** 2 + (same["y_x"] - same["y_y"]).to_numpy() ** 2
            for k, limit in enumerate(wide):
                gone = same[d2 <= limit]
                np.subtract.at(found[..., k], (gone["c_x"].to_numpy(),) if alike else (gone["c_x"].to_numpy(), gone["c_y"].to_numpy()), 1)
            # Within a cell both orders were met, between cells one.
            total += found if inside else 2 * found if alike else found + found.transpose(1, 0, 2)
        total[..., 1:] -= total[..., :-1].copy()
        at_ = np.nonzero(total)
        i, c = at_[0], at_[0] if alike else at_[1]
        label = group.schema.field("c").type
        return pa.Table.from_pandas(pd.DataFrame({"cluster_i": names[i], "cluster_c": names[c], "k": at_[-1].astype(np.int32), "n": total[at_]}), pa.schema([("cluster_i", label), ("cluster_c", label), ("k", pa.int32()), ("n", pa.int64())]), preserve_index=False)

    kind = dict(points.dtypes)["c"]
    counted = both.groupBy(*at, "p", "q").applyInArrow(run, f"cluster_i {kind}, cluster_c {kind}, k int, n long")
    return counted.groupBy("cluster_i", "cluster_c", "k").agg(F.sum("n").alias("n"))
