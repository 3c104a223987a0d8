"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) lead to.

    Each round links every neighbour of a node to the smallest one among them; a node's neighbours meet only in a
    minimum and a join, never in one list, so a node with very many neighbours is no special case. Self-loops and
    null ends are ignored; a node without an edge is not returned. No edges give no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = written(small.distinct())
        left = after.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        tops = left.select(F.col("b").alias("a")).distinct()
        # done when each node has one parent, and no parent has a parent
        busy = left.where("n > 1").select("a").unionByName(left.join(tops, "a", "left_semi").select("a"))
        now = after
        if busy.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def roots(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) of a forest (b, a), where each b occurs once and a < b: the root above each node, and each root itself.

    Every round points each node at its parent's parent, so there are as many rounds as the depth has binary digits."""
    now = written(parents.select("b", "a"))
    for _ in range(rounds):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("higher"))
        after = written(now.join(up, "a", "left").select("b", F.coalesce("higher", "a").alias("a"), F.col("higher").isNotNull().alias("moved")))
        now = after.select("b", "a")
        if after.where("moved").isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError("the parents do not form a forest")
