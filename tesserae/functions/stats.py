"""Statistics as column expressions: permutations, multiple testing, the normal distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import materialise

#: Coefficients of the rational approximation 26.2.17 of the normal distribution
#: function in the Handbook of Mathematical Functions; its error is below 7.5e-8.
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """The upper tail of the standard normal distribution."""
    a = F.abs(z)
    t = 1 / (1 + NORMAL_P * a)
    b1, b2, b3, b4, b5 = NORMAL_B
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * (t * (b1 + t * (b2 + t * (b3 + t * (b4 + t * b5)))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_tail_sql(z: str) -> str:
    b1, b2, b3, b4, b5 = NORMAL_B
    t = f"(1 / (1 + {NORMAL_P} * abs({z})))"
    tail = f"(exp(-abs({z}) * abs({z}) / 2) / 2.5066282746310002 * ({t} * ({b1} + {t} * ({b2} + {t} * ({b3} + {t} * ({b4} + {t} * {b5}))))))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def adjust(df: DataFrame, p: str, by: Sequence[str] = (), key: Sequence[str] = (), method: str = "fdr_bh", out: str | None = None) -> DataFrame:
    """Adjusted p-values within groups; nulls take no part and stay null."""
    part = Window.partitionBy(F.col(p).isNull(), *by)
    m = F.count(p).over(part)
    if method == "bonferroni":
        value = F.least(F.lit(1.0), F.col(p) * m)
    elif method == "fdr_bh":
        rank = F.row_number().over(part.orderBy(p, *key))
        down = part.orderBy(F.col(p).desc(), *[F.col(k).desc() for k in key])
        value = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn("_m", m).withColumn("_r", rank)
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn(out or f"{p}_adj", F.when(F.col(p).isNotNull(), value)).drop("_m", "_r")


def quantile(df: DataFrame, value: str, q: float, rows: int = 100_000) -> float | None:
    """The exact quantile of a column's values, linear between two; null without any.

    Counts in 4096 equal parts of the range tell in which part a rank lies; that part is
    divided again until at most ``rows`` values are in it or all are equal, so
    no task holds more than these.
    """
    here = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    box = here.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not box["n"]:
        return None
    at = q * (box["n"] - 1)

    def ranked(rank: int) -> float:
        low, high, n, before = box["lo"], box["hi"], box["n"], 0
        while low < high and n > rows:
            part = F.least(F.floor((F.col("v") - low) / (high - low) * 4096), F.lit(4095))
            inside = here.where(F.col("v").between(low, high)).groupBy(part.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            for row in sorted(inside.collect(), key=lambda r: r["k"]):  # 4096 rows at most
                if before + row["n"] > rank:
                    low, high, n = row["lo"], row["hi"], row["n"]
                    break
                before += row["n"]
        if low == high:
            return low
        return sorted(r["v"] for r in here.where(F.col("v").between(low, high)).collect())[rank - before]  # at most ``rows``

    low = ranked(int(at))
    return low if at == int(at) else low + (ranked(int(at) + 1) - low) * (at - int(at))


def number_rows(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the order of a column; no task sees them all.

    Range partitions are sorted and numbered by themselves; what comes before each is the
    sum of the sizes of the others, a row for each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its low bits count within a partition
    runs = materialise(sorted_.withColumns({"_part": F.spark_partition_id(), "_inside": inside}), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as partitions
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return runs.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_inside") + 1).cast("long")).select(*rows.columns, name)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank, from 1, of a column's value; equal values share the average of their ranks.

    Different values are counted and dealt by range; each range adds up its own counts, and
    what lies before it is a sum over ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(parts, value)
    runs = materialise(counts.withColumn("_part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("_part").agg(F.sum("_n").alias("_all"))  # as many rows as partitions
    starts = sizes.select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = runs.withColumn("_inside", inside).join(F.broadcast(starts), "_part").select(value, (F.col("_start") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranked, value).select(*df.columns, name)


def permuted(nodes: DataFrame, n_perms: int, seed: int, value: str = "cl", by: Sequence[str] = ()) -> DataFrame:
    """``perm, id, value``: labels reordered by a hash of seed, permutation and id.

    Within each stratum the id with the r-th hash receives the label of the r-th id, so
    the result is the same for any partitioning, and in any engine with md5.
    """
    strata = list(by)
    ranked = nodes.select(*strata, "id", value)
    if strata:
        labels = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("id"))).select(*strata, "_r", value)
    else:
        labels = number_rows(ranked, "id", "_r").select("_r", value)
    many = ranked.drop(value).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))))
    code = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm"), F.col("id")))
    drawn = many.withColumn("_r", F.row_number().over(Window.partitionBy("perm", *strata).orderBy(code, "id")))
    # Labels are as many as cells: merged, since Spark takes them for small by their compressed size.
    return drawn.join(labels.hint("merge"), [*strata, "_r"]).select("perm", *strata, "id", value)


def permuted_sql(nodes: str, n_perms: int, seed: int, value: str = "cl", by: Sequence[str] = ()) -> str:
    part = "".join(f", {b}" for b in by)
    over = f"PARTITION BY {', '.join(by)} " if by else ""
    match = "".join(f" AND d.{b} = l.{b}" for b in by)
    pick = "".join(f", d.{b}" for b in by)
    return f"""(SELECT d.perm{pick}, d.id, l.{value} FROM
 (SELECT perm, id{part}, row_number() OVER (PARTITION BY perm{part} ORDER BY md5(concat_ws('|', {seed}, perm, id)), id) AS r FROM {nodes}, range({n_perms}) p(perm)) d
 JOIN (SELECT {value}{part}, row_number() OVER ({over}ORDER BY id) AS r FROM {nodes}) l ON d.r = l.r{match})"""
