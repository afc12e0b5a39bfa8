"""Weighted rendezvous sharding of stable record keys (DataFrame functions only).

Each (key, shard) pair gets a hash u in (0, 1), of the first 52 bits of an MD5 digest so
that other engines can repeat it; a key goes to the shard with the
smallest ``-ln(u) / weight``.  A shard that joins can only win keys for itself and
a shard that leaves only gives up its own, so as few records move as possible.

Defined results: a null key is hashed like the empty string; a null text has no
bytes; repeated rows get the same shard and different slots, by the further columns and
then in any order; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are counted in two steps: rows of a shard fall into this many hash buckets,
#: each numbered by itself.  The table of bucket sizes has shards x buckets rows.
SLOT_BUCKETS = 1024


#: Hexadecimal digits of a digest that make a number; it is exact as a double.
DIGITS = 13


def digest_number(*parts: Column) -> Column:
    """A number from 0 to 2^52 - 1 hashed from the parts' text; nulls count as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def shard_cost(key: Column, shard: int, weight: float, seed: int) -> Column:
    """``-ln(u) / weight`` for u hashed from the seed, the shard's number and the key."""
    if weight <= 0:
        raise ValueError("weights must be positive")
    unit = (digest_number(F.lit(seed), F.lit(shard), key).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard of ``key`` among ``len(weights)`` weighted shards."""
    best = [F.struct(shard_cost(key, i, w, seed).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*best) if len(best) > 1 else best[0])["shard"].cast("int")


def assign(docs: DataFrame, key: str, weights: Sequence[float], extra: dict[str, Column] | None = None, seed: int = 0, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Key, shard, gapless slot in the shard, and the shard if one more joined.

    ``extra`` names further columns to compute from the input.  The slot of a row is
    the number of rows in earlier hash buckets of its shard plus its rank in its own
    bucket, so no task ever holds a whole shard.
    """
    grown = [*weights, sum(weights) / len(weights)]
    keyed = docs.select(
        F.col(key).alias("_key"),
        rendezvous(F.col(key), weights, seed).alias("_shard"),
        (digest_number(F.lit("slot"), F.col(key), *(extra or {}).values()) % buckets).cast("int").alias("_bucket"),
        rendezvous(F.col(key), grown, seed).alias("_grown"),
        *[c.alias(f"_x_{n}") for n, c in (extra or {}).items()],
    )
    sizes = keyed.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_key", *[f"_x_{n}" for n in extra or {}])
    placed = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    if len(weights) * buckets <= 1 << 17:  # a bound on its rows, whatever the input
        starts = F.broadcast(starts)
    out = placed.join(starts, ["_shard", "_bucket"])
    return out.select(
        F.col("_key").alias(key),
        *[F.col(f"_x_{n}").alias(n) for n in (extra or {})],
        F.col("_shard").alias("shard"),
        (F.col("_start") + F.col("_rank")).cast("long").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )
