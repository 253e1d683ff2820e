"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import stage


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    around = both_ways(edges)
    least = around.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    return around.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b longs, a <> b) but the roots themselves; the root is
    the least node of the component."""
    now = stage(small_star(edges.select("a", "b").where("a <> b").distinct()), "edges")
    for _ in range(rounds):
        # done when no root is linked further down
        if now.join(now.select(F.col("a").alias("r")), F.col("b") == F.col("r"), "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stage(small_star(large_star(now)), "edges")
    raise RuntimeError("components did not settle")
