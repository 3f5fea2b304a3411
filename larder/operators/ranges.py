"""Numbering rows in a total order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.operators.lineage import checkpoint


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with `name` from 0 in the order of columns: dealt by ranges, numbered within each, and moved on by the counts of the ranges before.

    The ranges come from a sample, so the dealt rows are checkpointed: both uses see the same. Besides a
    range, only the ranges' counts meet in one task.
    """
    spread = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = spread.withColumn("_i", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_i") - 1).drop("_part", "_i", "_before")


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each new name of sums, what a column adds up to over the rows before in the order of columns, which have to tell all rows apart.

    As in numbered, rows are dealt by ranges and only the ranges' sums meet in one task.
    """
    spread = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before_row, before_part = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    within = spread.withColumns({new: F.coalesce(F.sum(c).over(before_row), nothing) for new, c in sums.items()})
    parts = spread.groupBy("_part").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    before = parts.select("_part", *[F.coalesce(F.sum(f"_{new}").over(before_part), nothing).alias(f"_{new}") for new in sums])
    joined = within.join(F.broadcast(before), "_part")
    return joined.withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums}).drop("_part", *[f"_{new}" for new in sums])
