"""Verification of what a store serves against an independent ledger of what it acknowledged.

ledger: key, digest, size. reads: key, status, digest, size, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def acknowledged(writes: DataFrame) -> DataFrame:
    """(key, digest, size) of acknowledged writes (status 200 or 201), the first of each key staying."""
    first = F.min_by(F.struct("digest", "size"), "seq")
    return writes.where(F.col("status").isin(200, 201)).groupBy("key").agg(first.alias("x")).select("key", "x.*")


def refused(writes: DataFrame) -> DataFrame:
    """Keys whose writes were refused (503) and that no write acknowledged since."""
    return writes.where("status = 503").select("key").distinct().join(acknowledged(writes), "key", "left_anti")


def corrupted_reads(reads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reads that were served with another digest or size than the ledger has."""
    served = reads.where("status = 200 AND error IS NULL").select("key", F.col("digest").alias("got_digest"), F.col("size").alias("got_size"))
    both = served.join(ledger, "key")
    return both.where((F.col("got_digest") != F.col("digest")) | (F.col("got_size") != F.col("size"))).select("key", "digest", "got_digest", "size", "got_size")


def final_verification(ledger: DataFrame, reads: DataFrame) -> DataFrame:
    """How the ledger's objects fare at the end: correct, corrupted, missing or unreadable (digests only)."""
    rows = ledger.select("key", "digest").join(reads.select("key", "status", F.col("digest").alias("got"), "error", F.lit(True).alias("read")), "key", "left")
    kind = F.when(F.coalesce("read", F.lit(False)) & F.col("error").isNull() & (F.col("status") == 404), "missing").when(F.col("read").isNull() | F.col("error").isNotNull() | (F.col("status") != 200), "unreadable").when(F.col("got") == F.col("digest"), "correct").otherwise("corrupted")
    n = lambda c: F.count_if(F.col("k") == c).alias(c)
    return rows.select(kind.alias("k")).agg(F.count("*").alias("checked"), n("correct"), n("corrupted"), n("missing"), n("unreadable"))


def listing_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names (name, digest) that are only in a, only in b, or differ; no rows if both are the same."""
    both = a.select("name", F.col("digest").alias("digest_a")).join(b.select("name", F.col("digest").alias("digest_b")), "name", "full_outer")
    kind = F.when(F.col("digest_b").isNull(), "only_a").when(F.col("digest_a").isNull(), "only_b").when(F.col("digest_a") != F.col("digest_b"), "differs")
    return both.withColumn("difference", kind).where("difference IS NOT NULL")
