"""Connected components and reachability as joins and aggregations.

Components alternate large and small stars: every node's larger neighbours are linked to the
smallest one, then its smaller neighbours, until the edges are stars around component minima. The
edges never leave the executors; rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.scratch import discard, materialise_at


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node that has an edge; ``root`` is the least node of its component.

    Edges may repeat, point either way, or be loops (a node with only a loop is left out).
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    e, path = materialise_at(e, "edges", "snappy")
    told = _fingerprint(e)
    for _ in range(most_rounds):
        before = path
        e, path = materialise_at(_small_star(_large_star(e)), "stars", "snappy")
        discard(e.sparkSession, before)
        now = _fingerprint(e)
        if now == told:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        told = now
    raise RuntimeError("components did not settle")


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    linked = both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    linked = e.join(least, F.col("u") == F.col("c"))
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def successors(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """All pairs (``child``, ``ancestor``) reachable over ``child, parent``; paths double each round.

    Cycles are fine: a round that adds nothing ends it. A node on a cycle is its own ancestor.
    """
    reach, path = materialise_at(edges.select("child", F.col("parent").alias("ancestor")).distinct(), "reach", "snappy")
    n = reach.count()
    for _ in range(most_rounds):
        step = reach.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = reach.join(step, "ancestor").select("child", F.col("further").alias("ancestor"))
        before = path
        reach, path = materialise_at(reach.unionByName(longer).distinct(), "reach", "snappy")
        discard(reach.sparkSession, before)
        if (now := reach.count()) == n:
            return reach
        n = now
    raise RuntimeError("successors did not settle")
