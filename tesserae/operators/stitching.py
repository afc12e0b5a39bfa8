"""Tables of stitched cells: one row for each group of pieces."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

Strategy = str | Callable[[pd.Series], float]
STRATEGIES = ("sum", "min", "max", "mean", "median", "first")
#: Columns that say where a cell is (averaged), how bad its worst piece is (greatest), and what all pieces share (the first piece's).
PLACES = ("centroid_y", "centroid_x")
SCORES = ("max_straight_edge_ratio", "cardinal_alignment_score", "cut_score", "smoothed_cut_score", "nhood_outlier_fraction", "is_outlier")
SHARED = ("group_id", "is_stitched", "n_pieces", "confidence", "region")


def _checked(strategy: Strategy) -> None:
    if not callable(strategy) and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)} or a function of a series")


def _merged(column: Column, strategy: Strategy, order: Column) -> Column:
    if callable(strategy):

        def run(values: pd.Series) -> float:
            return float(strategy(values))

        return F.pandas_udf(run, "double")(column)
    if strategy == "first":
        return F.min_by(column, order)
    return {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[strategy](column)


def stitched_table(cells: DataFrame, groups: DataFrame, strategy: Strategy = "sum") -> DataFrame:
    """``cells`` (``label`` and any columns) with a row for each ``group_id`` of ``qc.stitch_groups``, named by it.

    Places are averaged, scores keep the worst piece's, other numbers follow ``strategy``, and
    all else is the first piece's; pieces are in order of their labels.  Cells without a group are their own.
    A group has few pieces, so its values may meet in one task.
    """
    _checked(strategy)
    joined = cells.join(groups.select("label", "group_id", "n_pieces", "confidence"), "label", "left").withColumn("group_id", F.coalesce("group_id", F.col("label")))
    made = [F.coalesce(F.first("n_pieces", ignorenulls=True), F.lit(1)).alias("n_pieces"), F.first("confidence", ignorenulls=True).alias("confidence")]
    order = F.col("label")
    out = []
    for field in cells.schema.fields:
        name, column = field.name, F.col(f"`{field.name}`")
        if name == "label" or name in SHARED[:4]:
            continue
        number = isinstance(field.dataType, NumericType)
        if name in PLACES and number:
            value = F.avg(column)
        elif name in SCORES and (number or isinstance(field.dataType, BooleanType)):
            value = F.max(column)
        elif number and name not in SHARED:
            value = _merged(column, strategy, order)
        else:
            value = F.min_by(column, order)
        out.append((name, value, callable(strategy) and number and name not in (*PLACES, *SCORES, *SHARED)))
    # Functions of series and built-in aggregates don't mix in one aggregation.
    plain = joined.groupBy("group_id").agg(*made, *[v.alias(n) for n, v, own in out if not own])
    own = [v.alias(n) for n, v, mine in out if mine]
    both = plain.join(joined.groupBy("group_id").agg(*own), "group_id") if own else plain
    return both.select(F.col("group_id").alias("label"), *[F.col(f"`{n}`") for n, _, _ in out], (F.col("n_pieces") > 1).alias("is_stitched"), "n_pieces", "confidence")


def stitched_features(features: DataFrame, groups: DataFrame, strategy: str = "sum") -> DataFrame:
    """``label, feature, value`` (absent values are 0) with the pieces of a group as one label.

    A piece without a value counts as 0 in every strategy; zeros are not made rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    # The first piece counts where it has no value too.
    leader = groups.groupBy("group_id").agg(F.min("label").alias("leader"), F.count(F.lit(1)).alias("pieces"))
    known = groups.select("label", "group_id").join(leader, "group_id")
    joined = features.join(known, "label", "left").select("feature", "value", "label", F.coalesce("group_id", "label").alias("group_id"), F.coalesce("leader", "label").alias("leader"), F.coalesce("pieces", F.lit(1)).alias("pieces"))
    some = joined.groupBy("group_id", "feature").agg(F.first("pieces").alias("pieces"), F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("v"), F.max(F.when(F.col("label") == F.col("leader"), F.col("value"))).alias("lead"))
    missing = F.array_repeat(F.lit(0.0), (F.col("pieces") - F.size("v")).cast("int"))
    full = some.withColumn("v", F.sort_array(F.concat("v", missing)))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    half = F.floor((F.size("v") - 1) / 2).cast("int")
    value = {
        "sum": total,
        "mean": total / F.size("v"),
        "min": F.element_at("v", 1),
        "max": F.element_at("v", -1),
        "median": (F.get("v", half) + F.get("v", F.size("v") - 1 - half)) / 2,
        "first": F.coalesce("lead", F.lit(0.0)),
    }[strategy]
    return full.select(F.col("group_id").alias("label"), "feature", value.alias("value")).where("value <> 0")
