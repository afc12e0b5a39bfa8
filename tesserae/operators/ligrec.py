"""Ligand-receptor pairs between clusters, tested by permutations of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.stats import adjust, permuted
from tesserae.session import materialise


def prepare_interactions(spark: SparkSession, interactions) -> DataFrame:
    """``source, target`` in upper case without nulls or repeats, from a table, pairs, two lists or names.

    A list of names stands for all ordered pairs of them.
    """
    if isinstance(interactions, DataFrame):
        rows = interactions.select("source", "target")
    elif isinstance(interactions, dict):
        rows = spark.createDataFrame(list(zip(interactions["source"], interactions["target"], strict=True)), "source string, target string")
    else:
        items = list(interactions)
        if not items:
            raise ValueError("no interactions")
        if all(isinstance(x, str) for x in items):
            names = list(dict.fromkeys(items))
            items = [(a, b) for a in names for b in names]
        elif len(items) == 2 and not isinstance(items[0], str) and len(items[0]) == len(items[1]) != 2:
            items = list(zip(*items, strict=True))
        rows = spark.createDataFrame([tuple(x) for x in items], "source string, target string")
    clean = lambda c: F.upper(F.regexp_replace(F.col(c), "^COMPLEX:", "")).alias(c)
    return rows.dropna(subset=["source", "target"]).select(clean("source"), clean("target")).distinct()


def resolve_complexes(interactions: DataFrame, means: DataFrame, policy: str = "min") -> DataFrame:
    """Replaces ``A_B`` complexes by the member with the least mean, or by every member.

    ``means`` has ``gene, mean``; members that it lacks don't count.
    """
    if policy not in ("min", "all"):
        raise ValueError("the policy must be min or all")
    out = interactions.select(F.col("source"), F.col("target"), F.col("source").alias("source_complex"), F.col("target").alias("target_complex"))
    for side in ("source", "target"):
        parts = out.withColumn("_m", F.explode(F.split(side, "_"))).join(means.withColumnsRenamed({"gene": "_m", "mean": "_v"}), "_m")
        if policy == "all":
            out = parts.withColumn(side, F.col("_m")).drop("_m", "_v")
        else:
            keys = [c for c in out.columns if c != side]
            out = parts.groupBy(*keys).agg(F.min_by("_m", F.struct("_v", "_m")).alias(side))
    return out.select("source", "target").distinct()


def cluster_means(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """``cl, gene, mean, share``: mean and share of cells above zero; absent values are zeros."""
    size = labels.groupBy("cl").agg(F.count(F.lit(1)).alias("cells"))
    sums = expr.join(labels, "id").groupBy("cl", "gene").agg(F.sum("value").alias("s"), F.sum((F.col("value") > 0).cast("int")).alias("k"))
    return sums.join(size, "cl").select("cl", "gene", (F.col("s") / F.col("cells")).alias("mean"), (F.col("k") / F.col("cells")).alias("share"))


def _pair_means(means: DataFrame, pairs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    a = means.select(*extra, F.col("gene").alias("source"), F.col("cl").alias("cluster_1"), F.col("mean").alias("m1"), F.col("share").alias("f1"))
    b = means.select(*extra, F.col("gene").alias("target"), F.col("cl").alias("cluster_2"), F.col("mean").alias("m2"), F.col("share").alias("f2"))
    return pairs.join(a, "source").join(b, [*extra, "target"])


def ligrec(expr: DataFrame, labels: DataFrame, interactions: DataFrame, n_perms: int = 1000, threshold: float = 0.01, seed: int = 0, policy: str = "min", method: str | None = None, axis: str = "clusters", clusters: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``source, target, cluster_1, cluster_2, mean, pvalue``.

    The mean is that of both genes' cluster means, 0 where one is 0.  p is the share of
    permutations with a larger sum; pairs expressed in too few cells have none.
    """
    up = expr.withColumn("gene", F.upper("gene"))
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    overall = up.join(labels.select("id"), "id").groupBy("gene").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n)).select("gene", (F.col("s") / F.col("n")).alias("mean"))
    pairs = materialise(resolve_complexes(interactions, overall, policy), "interactions")
    used = pairs.select(F.col("source").alias("gene")).union(pairs.select("target")).distinct()
    own = materialise(up.join(used, "gene", "left_semi"), "expression")
    observed = _pair_means(cluster_means(own, labels), pairs)
    if clusters is not None:
        wanted = expr.sparkSession.createDataFrame(list(clusters), "cluster_1 string, cluster_2 string")
        observed = observed.join(F.broadcast(wanted), ["cluster_1", "cluster_2"], "left_semi")
    tested = (F.col("f1") >= threshold) & (F.col("f2") >= threshold) & (F.col("m1") > 0) & (F.col("m2") > 0)
    observed = materialise(observed.withColumn("tested", tested), "observed")
    size = labels.groupBy("cl").agg(F.count(F.lit(1)).alias("cells"))
    drawn = permuted(labels, n_perms, seed)
    # Sums per permutation, cluster and gene; their number doesn't depend on the cells'.
    sums = own.join(drawn.hint("merge"), "id").groupBy("perm", "cl", "gene").agg(F.sum("value").alias("s")).join(size, "cl")
    sims = sums.select("perm", "cl", "gene", (F.col("s") / F.col("cells")).alias("mean"))
    want = observed.where("tested").select("source", "target", "cluster_1", "cluster_2", (F.col("m1") + F.col("m2")).alias("obs"))
    a = sims.select("perm", F.col("gene").alias("source"), F.col("cl").alias("cluster_1"), F.col("mean").alias("s1"))
    b = sims.select("perm", F.col("gene").alias("target"), F.col("cl").alias("cluster_2"), F.col("mean").alias("s2"))
    perms = expr.sparkSession.range(n_perms).select(F.col("id").cast("int").alias("perm"))
    drawn_pairs = want.crossJoin(F.broadcast(perms)).join(a, ["perm", "source", "cluster_1"], "left").join(b, ["perm", "target", "cluster_2"], "left")
    larger = F.round(F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0)), 9) > F.round(F.col("obs"), 9)
    p = drawn_pairs.groupBy("source", "target", "cluster_1", "cluster_2").agg((F.sum(larger.cast("int")) / F.lit(float(n_perms))).alias("pvalue"))
    mean = F.when((F.col("m1") > 0) & (F.col("m2") > 0), (F.col("m1") + F.col("m2")) / 2).otherwise(0.0)
    out = observed.join(p, ["source", "target", "cluster_1", "cluster_2"], "left").select("source", "target", "cluster_1", "cluster_2", mean.alias("mean"), "pvalue")
    if method:
        by = ["cluster_1", "cluster_2"] if axis == "clusters" else ["source", "target"]
        out = adjust(out.withColumn("_p", F.coalesce("pvalue", F.lit(1.0))), "_p", by, ["source", "target", "cluster_1", "cluster_2"], method, "_q")
        out = out.withColumn("pvalue_adj", F.when(F.col("pvalue").isNotNull(), F.col("_q"))).drop("_p", "_q")
    return out


def significant(result: DataFrame, alpha: float = 0.001, means_range: tuple[float, float] = (float("-inf"), float("inf")), pvalue_threshold: float = 1.0, remove_empty: bool = True, remove_nonsig: bool = False) -> DataFrame:
    """The rows behind a dot plot: filtered, with -log10 p and log2(mean + 1)."""
    eps = 2.220446049250313e-16
    rows = result.where((F.col("mean") >= means_range[0]) & (F.col("mean") <= means_range[1]) & (F.col("pvalue").isNull() | (F.col("pvalue") <= pvalue_threshold)))
    if remove_empty:
        some = F.max(F.col("mean") > 0)
        rows = rows.withColumn("_k", some.over(Window.partitionBy("source", "target"))).where("_k").withColumn("_k", some.over(Window.partitionBy("cluster_1", "cluster_2"))).where("_k").drop("_k")
    if remove_nonsig:
        some = F.max(F.coalesce(F.col("pvalue") <= alpha, F.lit(False)))
        rows = rows.withColumn("_k", some.over(Window.partitionBy("source", "target"))).where("_k").drop("_k")
    return rows.withColumns({"neg_log10_p": -F.log10(F.col("pvalue") + eps), "log2_mean": F.log2(F.col("mean") + 1)})
