"""Joins that spread the rows of hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; so there are fewer hot keys than this.
HOT_ONE_IN = 1000


def _divided(right: DataFrame, on: list[str], weight: str, one_in: int) -> DataFrame:
    total = right.agg(F.sum(weight).alias("_total"))
    return right.crossJoin(F.broadcast(total)).withColumn("_is_hot", F.col(weight) * one_in > F.col("_total"))  # the right side is one row


def keep_known(left: DataFrame, right: DataFrame, on: list[str], weight: str, one_in: int = HOT_ONE_IN) -> DataFrame:
    """The rows of ``left`` whose key is in ``right``, both written tables as in ``join_unique``.

    Rows of hot keys stay where they are; ``weight`` need only be in proportion.
    """
    flagged = _divided(right, on, weight, one_in)
    hot = F.broadcast(flagged.where("_is_hot").select(*on))
    cold = flagged.where("not _is_hot").select(*on)
    return left.join(hot, on, "left_semi").unionByName(left.join(hot, on, "left_anti").join(cold, on, "left_semi"))


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weight: str, spread: list[str], how: str = "left", one_in: int = HOT_ONE_IN) -> DataFrame:
    """``left`` with the columns of the row of ``right`` that has the same key, else nulls.

    ``right`` is a written table with a row for each key at most, and counts in ``weight``
    the rows of ``left`` (or of a table at least as large) that have it.  Rows of hot keys
    meet a broadcast table of fewer than ``one_in`` rows and are then dealt by the hash of
    ``spread``, so no task gets them all.  Keys without nulls.
    """
    values = [c for c in right.columns if c not in on]
    packed = _divided(right, on, weight, one_in).select(*on, "_is_hot", F.struct(*values).alias("_v"))
    hot = F.broadcast(packed.where("_is_hot").select(*on, F.col("_v").alias("_hot")))
    cold = packed.where("not _is_hot").select(*on, F.lit(0).cast("long").alias("_dealt"), F.col("_v").alias("_cold"))
    dealt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread).bitwiseOR(F.lit(1)))
    both = left.join(hot, on, "left").withColumn("_dealt", dealt).join(cold, [*on, "_dealt"], "left")
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        both = both.where(found.isNotNull())
    return both.select(*left.columns, *[found[v].alias(v) for v in values])
