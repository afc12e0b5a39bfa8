"""Communities of a weighted graph: local moves, refinement inside communities, contraction, level after level.

A level moves nodes between communities while modularity gains, then splits each community
into well connected parts, and makes a node of each part.  The next level starts from the
communities of the one before.  Levels end when nothing is contracted any more or modularity stays.

Nodes move in halves that alternate by a hash, so that neighbors don't swap labels for
ever, and the best target is taken instead of a drawn one; so results depend on nothing but
the graph.  Weights of 0 or less and edges of a node to itself in the input count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialise

#: Gains are compared to so many digits, so that the order of sums decides nothing.
DIGITS = 9


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (``id, label``) on the graph of ``edges`` (``src, dst, w``), each row once in either direction."""
    e = edges.where("src <> dst and w > 0")
    named = e.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    inside, total = named.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    if not total:
        return 0.0
    ends = named.select(F.col("a").alias("label"), "w").union(named.select("b", "w")).groupBy("label").agg(F.sum("w").alias("k"))
    square = ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - resolution * square / (4.0 * total * total)


def _turn(r: int) -> Column:
    """Whether a node moves in round ``r``: each half in one of two rounds, other halves in the next two."""
    return F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2


def _moved(both: DataFrame, nodes: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """``id, k, label`` after moves to the neighboring label with the largest gain."""
    now = nodes.select("id", "k", "label")
    for r in range(rounds):
        sizes = now.groupBy("label").agg(F.sum("k").alias("size"))
        near = both.join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("in"))
        # A node may also stay where it has no neighbor.
        stay = now.select("id", "label", F.lit(0.0).alias("in"))
        asked = near.union(stay).groupBy("id", "label").agg(F.sum("in").alias("in"))
        own = now.select("id", F.col("label").alias("old"), "k").where(_turn(r))
        here = F.col("label") == F.col("old")
        outside = F.col("size") - F.when(here, F.col("k")).otherwise(0.0)
        gain = F.round((F.col("in") - F.lit(resolution / total) * F.col("k") * outside), DIGITS)
        scored = asked.join(own, "id").join(sizes, "label").select("id", "label", gain.alias("gain"), here.alias("same"))
        best = scored.groupBy("id").agg(F.max_by("label", F.struct("gain", "same", (-F.col("label")).alias("low"))).alias("best"))
        moved = now.join(best, "id", "left").select("id", "k", F.coalesce("best", "label").alias("label"), F.col("label").alias("old"))
        moved = materialise(moved, "moves")
        still = moved.where("label <> old").isEmpty()
        now = moved.drop("old")
        if still and r % 2:
            break
    return now


def _refined(both: DataFrame, moved: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """``id, k, label, part``: parts of communities, made of single nodes that join well connected parts of their community.

    Only single nodes move, and only to parts that hold still in that round.
    """
    scale = F.lit(resolution / total)
    whole = moved.groupBy("label").agg(F.sum("k").alias("all"))
    ends = both.join(moved.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(moved.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    inside = materialise(ends.where("a = b").select("src", "dst", "w"), "inside")
    held = inside.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("held"))
    # A node that hangs on its community by less than chance stays alone.
    bound = F.coalesce("held", F.lit(0.0)) >= scale * F.col("k") * (F.col("all") - F.col("k"))
    now = moved.join(whole, "label").join(held, "id", "left").select("id", "k", "label", "all", bound.alias("bound"), F.col("id").alias("part"))
    now = materialise(now, "parts")
    for r in range(rounds):
        parts = now.groupBy("part").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("many"))
        state = now.join(parts, "part").withColumn("goes", F.col("bound") & (F.col("many") == 1) & _turn(r))
        links = inside.join(state.select(F.col("id").alias("src"), F.col("part").alias("from")), "src").join(state.select(F.col("id").alias("dst"), F.col("part").alias("part"), "goes"), "dst")
        # Weight that leaves a part for the rest of its community.
        cut = links.where("from <> part").groupBy(F.col("from").alias("part")).agg(F.sum("w").alias("cut"))
        firm = state.where("not goes").select("part", "size", "all").distinct().join(cut, "part")
        firm = firm.where(F.col("cut") >= scale * F.col("size") * (F.col("all") - F.col("size"))).select("part", "size")
        asked = links.where("not goes").groupBy(F.col("src").alias("id"), "part").agg(F.sum("w").alias("in"))
        gain = F.round(F.col("in") - scale * F.col("k") * F.col("size"), DIGITS)
        scored = asked.join(state.where("goes").select("id", "k"), "id").join(firm, "part").select("id", "part", gain.alias("gain")).where("gain > 0")
        best = scored.groupBy("id").agg(F.max_by("part", F.struct("gain", (-F.col("part")).alias("low"))).alias("best"))
        joined = now.join(best, "id", "left").select("id", "k", "label", "all", "bound", F.coalesce("best", "part").alias("part"), F.col("part").alias("old"))
        joined = materialise(joined, "parts")
        still = joined.where("part <> old").isEmpty()
        now = joined.drop("old")
        if still and r % 2:
            break
    return now.select("id", "k", "label", "part")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20, levels: int = 30) -> DataFrame:
    """``id, label`` for every node with an edge to another; a label is the least id of its community.

    ``edges`` has ``src, dst, w`` with numbers as ids; rows for one pair, in either direction, are added up.
    An empty table has no communities.  ``rounds`` bounds the moves of one level; what still gains goes on
    in the next, with fewer nodes.
    """
    e = edges.where("src <> dst and w > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    first = materialise(e, "weights")
    graph = first
    both = graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    nodes = materialise(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("label", F.col("id")), "nodes")
    total = nodes.agg(F.sum("k")).first()[0]
    where = nodes.select("id", F.col("id").alias("node"))
    if not total:
        return where.select("id", F.col("node").alias("label"))
    best, reached = nodes.select("id", "label"), modularity(first, nodes, resolution)
    many = every = nodes.count()
    for _ in range(levels):
        moved = _moved(both, nodes, total, resolution, rounds)
        labels = materialise(where.join(moved.select(F.col("id").alias("node"), "label"), "node").select("id", "label"), "communities")
        now = modularity(first, labels, resolution)
        if now > reached:
            best = labels
        if now <= reached + 10**-DIGITS and many < every:
            break
        reached = max(now, reached)
        parts = _refined(both, moved, total, resolution, rounds)
        # A part's community goes by the least part in it, so that labels are nodes of the next level.
        named = parts.join(parts.groupBy("label").agg(F.min("part").alias("named")), "label")
        after = materialise(named.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.min("named").alias("label")), "nodes")
        left = after.count()
        if left == many:
            break
        name = parts.select("id", "part")
        where = materialise(where.join(name.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")), "where")
        ends = both.join(name.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(name.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst")
        both = materialise(ends.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "weights")
        nodes, many = after, left
    least = best.groupBy("label").agg(F.min("id").alias("least"))
    return best.join(least, "label").select("id", F.col("least").alias("label"))
