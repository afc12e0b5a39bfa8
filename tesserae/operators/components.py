"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tesserae.session import drop_path, scratch_path

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges ``u, v`` as stars: every node that isn't the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """What each task sees of ``u, v`` as stars; edges between nodes that aren't whole numbers stay as they are."""
    if not isinstance(edges.schema["u"].dataType, IntegralType):
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            made = contract(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(m, held[0].schema.field(0).type) for m in made], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges``; edges may repeat.

    Every task first replaces the edges that it reads by stars around their smallest nodes.  Then
    two steps alternate until all is one star for each component: the smaller neighbours of a
    node, and the node, point to the least of them; and a node that points to another points to
    what that one points to, so paths shorten by half or more.  Every round is written to the shared folder.
    A node with many larger neighbours is only ever a key of a grouped minimum and of a join.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    path = scratch_path(spark, "components")
    now.write.parquet(path)
    schema = now.schema
    now = spark.read.schema(schema).parquet(path)
    for _ in range(max_rounds):
        # Small star: of a node's edges, the one to its least neighbour stays, the others lead from there.
        least = _contracted(now).withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # Jump: an edge to a node that has less neighbours leads to the least of them.
        up = small.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        jumped = small.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        new_path = scratch_path(spark, "components")
        jumped.write.parquet(new_path)
        drop_path(spark, path)
        now, path = spark.read.schema(schema).parquet(new_path), new_path
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(None).cast(schema["v"].dataType).alias("up")))
        named = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("center"))
        if not named.where("low <> high or (low is not null and center)").count():
            return named.select("node", F.coalesce("low", "node").alias("component"))
    raise RuntimeError("components did not settle")
