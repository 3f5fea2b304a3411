"""Deterministic inputs: objects, keys that exist nowhere, unique writes, layered graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.hashing import sha256_hex


def drawn(*of: Column | int) -> Column:
    """A number below 2**60 that depends on these alone: the first 15 hexadecimal digits of the MD5 of them as text, by slashes."""
    text = F.concat_ws("/", *[(F.lit(x) if isinstance(x, int) else x).cast("string") for x in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def corpus(spark: SparkSession, name: str, count: int, size: int, seed: int) -> DataFrame:
    """(id, content, key): objects of `size` bytes that depend on name, seed and id only, and their digests as keys."""
    block = lambda n: F.unhex(sha256_hex(F.concat_ws("/", F.lit(name), F.lit(str(seed)), F.col("id").cast("string"), n.cast("string"))))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(1, -(-size // 32)) - 1)), block)
    content = F.substring(F.aggregate(blocks, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)), 1, size)
    return spark.range(count).withColumn("content", content).withColumn("key", sha256_hex(F.col("content")))


def sequence_keys(spark: SparkSession, count: int, prefix: str = "object-") -> DataFrame:
    """(id, key): digests of a prefix and a number, the keys of the published placement figures."""
    return spark.range(count).withColumn("key", sha256_hex(F.concat(F.lit(prefix), F.col("id").cast("string"))))


def absent_keys(spark: SparkSession, count: int, seed: int) -> DataFrame:
    return spark.range(count).select(sha256_hex(F.concat_ws("/", F.lit("miss"), F.lit(str(seed)), F.col("id").cast("string"))).alias("key"))


def unique_objects(spark: SparkSession, workers: int, each: int, size: int) -> DataFrame:
    """(worker, n, content, key): objects that no two workers or turns share, by a stamp of both in front."""
    stamp = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    rows = spark.range(workers * each).select((F.col("id") % workers).alias("worker"), F.expr(f"id div {workers}").alias("n"))
    content = F.concat(stamp(F.col("worker")), stamp(F.col("n")), F.lit(b"\0" * max(0, size - 16)).cast("binary"))
    return rows.withColumn("content", content).withColumn("key", sha256_hex(F.col("content")))


def layered_graph(spark: SparkSession, libraries: int, layers: int, fan_in: int, seed: int) -> DataFrame:
    """(target, dep): each library depends on up to fan_in of the layer before its own."""
    layer = lambda i: F.expr(f"{i} * {layers} div {libraries}")
    libs = spark.range(libraries).select(F.col("id").alias("target"), layer("id").alias("layer")).where("layer > 0")
    first = F.ceil((F.col("layer") - 1) * libraries / layers)
    width = F.ceil(F.col("layer") * libraries / layers) - first
    edges = libs.select("target", "layer", first.alias("first"), width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(fan_in - 1))).alias("k"))
    dep = F.col("first") + drawn(seed, F.col("target"), F.col("k")) % F.col("width")
    return edges.where("width > 0").select("target", dep.cast("long").alias("dep")).distinct()


def fault_schedule(spark: SparkSession, nodes: list[str], seconds: int, every: int, down: int) -> DataFrame:
    """(fault, node, from_s, to_s): one node down at a time, in turn, as long as the run lasts."""
    names = F.array(*map(F.lit, nodes))
    rows = spark.range(max(0, seconds // every)).select(F.col("id").alias("fault"), F.element_at(names, (F.col("id") % len(nodes) + 1).cast("int")).alias("node"), ((F.col("id") + 1) * every).alias("from_s"))
    return rows.withColumn("to_s", F.least(F.col("from_s") + down, F.lit(seconds))).where("from_s < to_s")


def mixed_operations(spark: SparkSession, count: int, objects: int, seed: int, read_share: float = 0.8, miss_share: float = 0.2) -> DataFrame:
    """(id, op, object): a reproducible mix of reads of known objects, reads of absent ones (object null) and writes."""
    u = lambda n: (drawn(seed, n, F.col("id")) % 1_000_003) / F.lit(1_000_003.0)
    op = F.when(u(1) < read_share, F.when(u(2) < miss_share, "miss").otherwise("get")).otherwise("put")
    rows = spark.range(count).withColumn("op", op)
    return rows.withColumn("object", F.when(F.col("op") != "miss", drawn(seed, 3, F.col("id")) % objects))
