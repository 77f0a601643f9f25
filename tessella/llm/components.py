"""Connected components of a graph that is larger than any one machine.

Large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Every step is joins and minima, so a node with very many neighbours is combined before the shuffle and its join
partition can be split. Each round's edges are kept in the shared folder; nothing is gathered on the driver.

Nodes are of any type that Spark can order, structs included. Defined cases: an edge with a null end and an edge from
a node to itself link nothing; repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node it can reach."""
    now = cut_lineage(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # a forest of stars: each node has one smaller neighbour, which has none
        roles = now.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        roles = roles.union(now.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if roles.filter("child > 1 or (child > 0 and parent > 0)").isEmpty():
            break
        now = cut_lineage(_small_star(_large_star(now).filter("a <> b").distinct()))
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
