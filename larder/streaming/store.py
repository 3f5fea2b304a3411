"""Streams over a store's accesses: touch batches, eviction sweeps and memory peaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import eviction, index

ACCESSES = "ns string, key string, at_ns long, kind string"


def accesses(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ACCESSES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class Snapshots:
    """The index as numbered snapshots under one folder: a batch reads the last and writes the next, so readers never see half of one.

    A batch that is run again after a failure finds the snapshot of its predecessor and writes the same one anew.
    """

    def __init__(self, spark: SparkSession, folder: str, first: DataFrame):
        self.spark, self.folder = spark, folder
        first.write.mode("overwrite").parquet(self.path(-1))

    def path(self, n: int) -> str:
        return f"{self.folder}/snapshot-{n + 1}"

    def read(self, n: int) -> DataFrame:
        return self.spark.read.schema(index.OBJECTS).parquet(self.path(n))

    def advance(self, n: int, change: Callable[[DataFrame], DataFrame]) -> None:
        change(self.read(n - 1)).write.mode("overwrite").parquet(self.path(n))


def flush_touches(stream: DataFrame, snapshots: Snapshots, checkpoint: str, seconds: int | None = 5):
    """Applies each micro-batch's touches to the index, one an object and batch. Without `seconds`, takes what there is and ends.

    Nothing is dropped however many objects a batch touches: a batch's touches are one aggregation.
    """

    def batch(rows: DataFrame, n: int) -> None:
        snapshots.advance(n, lambda objects: index.flush_touches(objects, rows))

    return _started(stream, batch, checkpoint, seconds)


def sweep(stream: DataFrame, snapshots: Snapshots, checkpoint: str, max_bytes: int, high: float, low: float, seconds: int | None = 30):
    """Applies each micro-batch's touches, so that eviction sees them, and then evicts down to the low-water mark if usage is over the high one."""

    def batch(rows: DataFrame, n: int) -> None:
        def change(objects: DataFrame) -> DataFrame:
            now = index.flush_touches(objects, rows)
            return index.remove(now, eviction.victims(now, max_bytes, high, low))

        snapshots.advance(n, change)

    return _started(stream, batch, checkpoint, seconds)


def _started(stream: DataFrame, batch, checkpoint: str, seconds: int | None):
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def memory_peaks(samples: DataFrame, window: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Highest resident memory of each node in each window of a stream of samples (ts, node, rss_bytes)."""
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "node")
    return grouped.agg(F.max("rss_bytes").alias("rss_bytes")).select("window.start", "node", "rss_bytes")


def convergence_poll(probe: Callable[[], DataFrame], rounds: int, wait: Callable[[], None]) -> DataFrame:
    """Probes until nothing is under-replicated or unreadable, or the rounds are over; returns the last probe (one row, see repair.convergence)."""
    for n in range(rounds):
        row = probe()
        if n == rounds - 1 or row.first()["converged"]:
            return row
        wait()
    raise ValueError("no rounds")
