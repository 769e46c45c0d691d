"""Connected components by alternating large-star and small-star rounds.

Every round is a few shuffles over the links, pre-aggregated, and is written to the
shared folder. Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds grow with the logarithm of a component's length; more than this is a fault.
ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) to (node, root): root is the smallest node that links reach.

    Only nodes with links to another appear. Stops when all links point to roots.
    """
    edges = edges.where("a <> b").select("a", "b")
    for _ in range(ROUNDS):
        edges = common.stored(_small_star(_large_star(edges)), "star")
        parents = edges.select(F.col("b").alias("a")).distinct()
        deeper = edges.join(parents, "a", "left_semi").limit(1).count()
        many = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not deeper and not many:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"no fixed point in {ROUNDS} rounds")
