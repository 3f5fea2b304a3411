"""The index against what lies on disk, where the disk is right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.index import PK


def reconcile(disk: DataFrame, objects: DataFrame) -> DataFrame:
    """Every object on disk (ns, key, size, mod_ns) or in the index, with `class`: kept, size_corrected, added or removed_stale.

    Known objects keep their history and take the disk's size; new ones were made and read when their file was; index rows without a
    file are marked, for `survivors` to drop.
    """
    on_disk = disk.select(*PK, F.col("size").alias("disk_size"), "mod_ns")
    both = on_disk.join(objects, PK, "full_outer")
    there, known = F.col("disk_size").isNotNull(), F.col("size").isNotNull()
    kind = F.when(~there, "removed_stale").when(~known, "added").when(F.col("size") != F.col("disk_size"), "size_corrected").otherwise("kept")
    return both.select(
        *PK,
        F.coalesce("disk_size", "size").alias("size"),
        F.coalesce("created_ns", "mod_ns").alias("created_ns"),
        F.coalesce("last_access_ns", "mod_ns").alias("last_access_ns"),
        F.coalesce("access_count", F.lit(1).cast("long")).alias("access_count"),
        kind.alias("class"),
        known.alias("was_indexed"),
    )


def survivors(reconciled: DataFrame) -> DataFrame:
    return reconciled.where("class <> 'removed_stale'").drop("class", "was_indexed")


def counters(reconciled: DataFrame) -> DataFrame:
    stale = F.col("class") == "removed_stale"
    return reconciled.agg(
        F.count_if(~stale).alias("files_on_disk"),
        F.coalesce(F.sum(F.when(~stale, F.col("size"))), F.lit(0)).cast("long").alias("bytes_on_disk"),
        F.count_if("was_indexed").alias("indexed_before"),
        F.count_if(F.col("class") == "added").alias("added"),
        F.count_if(stale).alias("removed_stale"),
        F.count_if(F.col("class") == "size_corrected").alias("size_corrected"),
    )
