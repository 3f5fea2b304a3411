"""What to evict under a quota: the longest unread first, larger objects as if unread for longer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.rules import water_mark
from larder.operators.index import PK, totals
from larder.operators.lineage import checkpoint
from larder.operators.ranges import numbered

#: An object looks an hour older for each doubling above 64 KiB; candidates come in batches of 512.
SIZE_WEIGHT_NS, SIZE_UNIT, BATCH = 3_600_000_000_000, 64 << 10, 512
#: Groups that a group of batches is divided into.
FAN = 1_024

#: Fixed value: the reciprocal of the natural logarithm of 2. Terms of the series below.
RECIPROCAL, TERMS = 1.4426950408889634, 18


def with_score(objects: DataFrame, weight_ns: int = SIZE_WEIGHT_NS, unit: int = SIZE_UNIT) -> DataFrame:
    """objects with `score` = last access - weight * log2(1 + size / unit), the penalty truncated; the lowest is evicted first.

    Libraries' logarithms differ in their last bits, which would show in nanoseconds. The logarithm is therefore taken as the
    exponent plus a series in s = (f - 1) / (f + 1) for the fraction f in [1/2, 1): plain arithmetic, alike everywhere.
    """
    rows = objects.withColumn("_x", 1 + F.col("size") / F.lit(float(unit if unit > 0 else SIZE_UNIT)))
    rows = rows.withColumn("_e", F.floor(F.log2("_x")) + 1)
    f = F.col("_x") / F.pow(F.lit(2.0), F.col("_e"))
    rows = rows.withColumn("_f", f).withColumn("_s", (F.col("_f") - 1) / (F.col("_f") + 1)).withColumn("_z", F.col("_s") * F.col("_s"))
    series = F.lit(1.0 / (2 * TERMS - 1))
    for k in range(TERMS - 2, -1, -1):
        series = F.lit(1.0 / (2 * k + 1)) + F.col("_z") * series
    log2 = F.when(F.col("_f") == 0.5, (F.col("_e") - 1).cast("double")).otherwise(F.col("_e") + 2 * F.col("_s") * series * F.lit(RECIPROCAL))
    return rows.withColumn("score", F.col("last_access_ns") - (log2 * F.lit(float(weight_ns))).cast("long")).drop("_x", "_e", "_f", "_s", "_z")


def victims(objects: DataFrame, max_bytes: int, high: float, low: float, weight_ns: int = SIZE_WEIGHT_NS, unit: int = SIZE_UNIT, batch: int = BATCH) -> DataFrame:
    """The rows that a sweep evicts, with `score` and `order` (from 1): nothing up to the high-water mark, else batch after batch
    of the coldest, each by score, until usage is at the low-water mark. Size weighs only within a batch.

    Objects are numbered from the coldest. The batch in which enough is freed is found by sums over groups of batches, of which only the
    group that it lies in is divided again: the driver gets at most FAN sums at a time, and what follows is a filter on the numbers.
    """
    used = totals(objects).select("bytes", water_mark(F.lit(max_bytes), F.lit(high)).alias("high"), water_mark(F.lit(max_bytes), F.lit(low)).alias("low")).first()
    must = used["bytes"] - used["low"] if used["bytes"] > used["high"] else 0
    rows = with_score(numbered(objects, "last_access_ns", *PK), weight_ns, unit)
    if must <= 0:
        return rows.limit(0).select(*PK, "size", "last_access_ns", "score", F.col("n").alias("order"))
    rows = checkpoint(rows)
    start, freed = boundary(rows, must, batch)
    own = W.partitionBy("batch").orderBy("score", *PK).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.where(F.col("n") < start + batch).withColumn("batch", F.floor(F.col("n") / batch))
    out = out.withColumns({"_own": F.sum("size").over(own) - F.col("size"), "_i": F.row_number().over(own)})
    return out.where((F.col("n") < start) | (freed + F.col("_own") < must)).select(*PK, "size", "last_access_ns", "score", (F.col("batch") * batch + F.col("_i")).alias("order"))


def boundary(rows: DataFrame, must: int, batch: int) -> tuple[int, int]:
    """(first number of the batch in which the sizes of rows (n, size), by number, reach must; the sum before it). The sum of all reaches it."""
    count, width = rows.agg(F.max("n")).first()[0] + 1, batch
    while width * FAN < count:
        width *= FAN
    start = freed = 0
    while True:
        inside = rows.where((F.col("n") >= start) & (F.col("n") < start + width * FAN))
        for r in inside.groupBy(F.floor(F.col("n") / width).alias("g")).agg(F.sum("size").alias("bytes")).orderBy("g").collect():
            start = r["g"] * width
            if freed + r["bytes"] >= must:
                break
            freed += r["bytes"]
        if width == batch:
            return start, freed
        width //= FAN


def usage(objects: DataFrame, max_bytes: int, high: float, low: float) -> DataFrame:
    """Objects, bytes, the marks and whether usage is over the high one."""
    marks = totals(objects).withColumns({"quota_bytes": F.lit(max_bytes).cast("long"), "high_water_bytes": water_mark(F.lit(max_bytes), F.lit(high)), "low_water_bytes": water_mark(F.lit(max_bytes), F.lit(low))})
    return marks.withColumn("over_high_water", F.col("bytes") > F.col("high_water_bytes"))
