"""Spatial autocorrelation: Moran's I and Geary's C for every feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.stats import adjust, normal_tail, number_rows
from tesserae.session import materialise


def row_normalised(edges: DataFrame) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", F.when(total != 0, F.col("w") / total).otherwise(0.0))


def weight_moments(edges: DataFrame) -> DataFrame:
    """One row with S0, S1 and S2 of the weights."""
    e = edges.select("src", "dst", "w")
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    both = e.join(turned, ["src", "dst"], "full").select((F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("s"), F.coalesce("w", F.lit(0.0)).alias("w"))
    s01 = both.agg(F.sum("w").alias("s0"), (F.sum(F.col("s") * F.col("s")) / 2).alias("s1"))
    sums = e.select(F.col("src").alias("id"), "w").union(e.select("dst", "w")).groupBy("id").agg(F.sum("w").alias("t"))
    return s01.crossJoin(sums.agg(F.sum(F.col("t") * F.col("t")).alias("s2")))


def _dense(nodes: DataFrame, expr: DataFrame) -> DataFrame:
    """Mean and number of cells of each feature, zeros of absent values included."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    sums = expr.join(nodes.select("id"), "id").groupBy("gene").agg(F.sum("value").alias("s"))
    return sums.crossJoin(F.broadcast(n)).withColumn("mean", F.col("s") / F.col("n"))


def statistic(edges: DataFrame, nodes: DataFrame, expr: DataFrame, mode: str) -> DataFrame:
    """``gene, stat, n``.  ``edges`` may have a ``perm`` column; then so has the result.

    Absent values are zeros.  The sum over edges is split into terms that need only
    values that are there: edges join the values of both ends and of either one.
    """
    if mode not in ("moran", "geary"):
        raise ValueError("mode must be moran or geary")
    perm = ["perm"] if "perm" in edges.columns else []
    ids = nodes.select("id")
    values = expr.join(ids, "id").select("id", "gene", "value")
    mean = _dense(nodes, expr).select("gene", "mean", "n")
    e = edges.select(*perm, "src", "dst", "w")
    s0 = e.groupBy(*perm).agg(F.sum("w").alias("s0"))
    out_sum = e.groupBy(*perm, F.col("src").alias("id")).agg(F.sum("w").alias("wo"))
    in_sum = e.groupBy(*perm, F.col("dst").alias("id")).agg(F.sum("w").alias("wi"))
    a = values.select(F.col("id").alias("src"), "gene", F.col("value").alias("xi"))
    b = values.select(F.col("id").alias("dst"), "gene", F.col("value").alias("xj"))
    cross = e.join(a, "src").join(b, ["dst", "gene"]).groupBy(*perm, "gene").agg(F.sum(F.col("w") * F.col("xi") * F.col("xj")).alias("xy"))
    o = values.join(out_sum, "id").groupBy(*perm, "gene").agg(F.sum(F.col("wo") * F.col("value")).alias("ox"), F.sum(F.col("wo") * F.col("value") * F.col("value")).alias("oxx"))
    i = values.join(in_sum, "id").groupBy(*perm, "gene").agg(F.sum(F.col("wi") * F.col("value")).alias("ix"), F.sum(F.col("wi") * F.col("value") * F.col("value")).alias("ixx"))
    square = values.groupBy("gene").agg(F.sum(F.col("value") * F.col("value")).alias("xx"))
    # Every feature is there, also one without values at any edge's end; s0 has a row for each permutation.
    all_ = mean.join(square, "gene").crossJoin(F.broadcast(s0))
    for part in (o, i, cross):
        all_ = all_.join(part, [*perm, "gene"], "left")
    all_ = all_.na.fill(0.0, ["xy", "ox", "oxx", "ix", "ixx"])
    m, n = F.col("mean"), F.col("n")
    total = F.col("xx") - n * m * m
    if mode == "moran":
        top = n * (F.col("xy") - m * (F.col("ox") + F.col("ix")) + m * m * F.col("s0"))
        stat = top / (F.col("s0") * total)
    else:
        stat = (n - 1) * (F.col("oxx") + F.col("ixx") - 2 * F.col("xy")) / (2 * F.col("s0") * total)
    return all_.select(*perm, "gene", F.when((total > 0) & (F.col("s0") > 0), stat).alias("stat"), "n")


def spatial_autocorr(edges: DataFrame, nodes: DataFrame, expr: DataFrame, mode: str = "moran", transformation: bool = True, n_perms: int | None = None, two_tailed: bool = False, method: str | None = "fdr_bh", seed: int = 0) -> DataFrame:
    """Statistic, analytic variance and p-value, and those of permutations when asked for.

    A permutation reorders the rows of the weights, as hashes of seed, number and id order them.
    Values that agree to 9 digits are equal, so sums in another order give the same p-value.
    """
    weights = materialise(row_normalised(edges) if transformation else edges, "weights")
    observed = statistic(weights, nodes, expr, mode)
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    with_moments = observed.crossJoin(F.broadcast(weight_moments(weights)))  # one row
    if mode == "moran":
        mean = -1.0 / (n - 1)
        var = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - mean * mean
    else:
        mean = F.lit(1.0)
        var = ((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)
    z = (F.col("stat") - mean) / F.sqrt(F.col("var_norm"))
    tail = normal_tail(F.abs(z))
    out = with_moments.withColumn("var_norm", var).withColumn("pval_norm", tail * 2 if two_tailed else tail).select("gene", "stat", "pval_norm", "var_norm")
    ps = ["pval_norm"]
    if n_perms:
        numbered = number_rows(nodes.select("id"), "id", "r")
        code = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm"), F.col("id")))
        many = nodes.select("id").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))))
        drawn = many.withColumn("r", F.row_number().over(Window.partitionBy("perm").orderBy(code, "id"))).join(numbered.withColumnRenamed("id", "src"), "r")
        moved = weights.select("src", "dst", "w").join(drawn.select("perm", "src", F.col("id").alias("new")), "src").select("perm", F.col("new").alias("src"), "dst", "w")
        sims = statistic(materialise(moved, "permuted-weights"), nodes, expr, mode).select("gene", F.col("stat").alias("sim"))
        own = sims.join(observed.select("gene", "stat"), "gene").groupBy("gene").agg(F.sum((F.round("sim", 9) >= F.round("stat", 9)).cast("int")).alias("c"), F.avg("sim").alias("ms"), F.var_pop("sim").alias("var_sim"))
        zs = F.abs(F.col("stat") - F.col("ms")) / F.sqrt("var_sim")
        low = F.least(F.col("c"), F.lit(n_perms) - F.col("c"))
        out = out.join(own, "gene", "left").withColumn("pval_sim", (low + 1) / F.lit(n_perms + 1.0)).withColumn("pval_z_sim", F.when(F.col("var_sim") > 0, normal_tail(zs))).drop("c", "ms")
        ps += ["pval_z_sim", "pval_sim"]
    for p in ps if method else []:
        out = adjust(out, p, key=["gene"], method=method, out=f"{p}_{method}")
    return out
