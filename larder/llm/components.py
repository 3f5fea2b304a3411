"""Connected components of a distributed edge list, by alternating star contractions.

Each round points the larger neighbours of every node at its smallest one, then the smaller ones
likewise; after a number of rounds that grows with the logarithm of the longest path every node
points at the smallest of its component. Only minima are gathered per node, so a node with very
many neighbours costs no task more than a partial sum, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint

ROUNDS = 100


def _smallest(pairs: DataFrame) -> DataFrame:
    """Checkpointed, so that both sides of the join that follows are shuffles whose skewed partitions can be split."""
    return checkpoint(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    low = _smallest(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (two columns of one ordered type); component is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are left out; an empty list gives an empty result.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    now = checkpoint(now.where("NOT x AND NOT y AND u <> v").select("u", "v").distinct())
    mark = None
    for _ in range(ROUNDS):
        now = checkpoint(_small_star(_large_star(now)))
        total = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if total == mark:
            break
        mark = total
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
