"""The object index as pure functions from DataFrame to DataFrame.

objects: ns, key, size, created_ns, last_access_ns, access_count; one row per (ns, key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PK = ["ns", "key"]
OBJECTS = T.StructType(
    [
        T.StructField("ns", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("created_ns", T.LongType(), False),
        T.StructField("last_access_ns", T.LongType(), False),
        T.StructField("access_count", T.LongType(), False),
    ]
)
META = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])
COLUMNS = [f.name for f in OBJECTS]


def upsert(objects: DataFrame, written: DataFrame) -> DataFrame:
    """objects after writes (ns, key, size, at_ns; later writes win): a known object keeps when it was created and its count, a new one starts at 1."""
    order = F.struct("at_ns", "size")
    new = written.groupBy(*PK).agg(F.max(order).alias("w"), F.min("at_ns").alias("first_ns"))
    both = objects.join(new, PK, "full_outer")
    return both.select(
        *PK,
        F.coalesce("w.size", "size").alias("size"),
        F.coalesce("created_ns", "first_ns").alias("created_ns"),
        F.coalesce("w.at_ns", "last_access_ns").alias("last_access_ns"),
        F.coalesce("access_count", F.lit(1).cast("long")).alias("access_count"),
    )


def remove(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows of gone (ns, key), which may be unknown or repeated."""
    return objects.join(gone.select(*PK), PK, "left_anti")


def stat(objects: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of the objects that lookups (ns, key, at_ns) name, and the accesses (ns, key, at_ns) that come of finding them."""
    found = lookups.select(*PK, "at_ns").join(objects, PK)
    return found, found.select(*PK, "at_ns")


def touched(accesses: DataFrame) -> DataFrame:
    """One touch per object from a batch of accesses (ns, key, at_ns): the latest."""
    return accesses.groupBy(*PK).agg(F.max("at_ns").alias("at_ns"))


def flush_touches(objects: DataFrame, accesses: DataFrame) -> DataFrame:
    """objects after a batch of accesses: the last access moves forward, never back, and the count rises by one a batch, however
    often an object was read in it. Accesses to unknown objects are ignored."""
    old = objects.join(touched(accesses), PK, "left")
    return old.select(
        *PK,
        "size",
        "created_ns",
        F.greatest("last_access_ns", F.coalesce("at_ns", "last_access_ns")).alias("last_access_ns"),
        (F.col("access_count") + F.col("at_ns").isNotNull().cast("long")).alias("access_count"),
    )


def totals(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def get(objects: DataFrame, ns: str, key: str) -> DataFrame:
    return objects.where((F.col("ns") == ns) & (F.col("key") == key))


def coldest(objects: DataFrame, n: int) -> DataFrame:
    """The n rows read longest ago, ties by ns and key; none for n <= 0."""
    return objects.orderBy("last_access_ns", *PK).limit(max(0, n))


def page_after(objects: DataFrame, ns: str, key: str, n: int) -> DataFrame:
    """The n rows that follow (ns, key) in order: a seek, not an offset."""
    return objects.where((F.col("ns") > ns) | ((F.col("ns") == ns) & (F.col("key") > key))).orderBy(*PK).limit(max(0, n))


def replace_all(entries: DataFrame) -> DataFrame:
    """The index made of entries, with counts of at least 1."""
    return entries.select(*PK, "size", "created_ns", "last_access_ns", F.greatest("access_count", F.lit(1).cast("long")).alias("access_count"))


def set_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """meta (key, value) with changes (key, value, seq) applied, the last of each key winning."""
    new = changes.groupBy("key").agg(F.max_by("value", "seq").alias("new"), F.lit(True).alias("set"))
    return meta.join(new, "key", "full_outer").select("key", F.when(F.col("set"), F.col("new")).otherwise(F.col("value")).alias("value"))
