"""Reading and writing what a store, its nodes and its tools leave in files. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.hashing import sha256_hex, valid_key
from larder.functions.rules import NAMESPACES
from larder.functions.text import split_metric

ACCESS_LOG = "time timestamp, level string, msg string, method string, path string, status int, bytes_out long, bytes_in long, duration_ms double, forwarded_by string"
STATS = "node string, usage struct<objects:long,bytes:long,quota_bytes:long,high_water_bytes:long,low_water_bytes:long,over_high_water:boolean>, eviction struct<sweeps:long,evicted:long,bytes_reclaimed:long,failures:long>"
BUILD_EVENT = """id struct<buildMetrics:struct<none:string>,buildFinished:struct<none:string>>,
    buildMetrics struct<actionSummary:struct<runnerCount:array<struct<name:string,count:long>>>,memoryMetrics:struct<peakPostGcHeapSize:long>>,
    finished struct<exitCode:struct<code:int>>"""
_LATENCY = "percentile:map<string,double>"
FIO = f"""`fio version` string, jobs array<struct<jobname:string,
    read:struct<iops_mean:double,bw:long,clat_ns:struct<{_LATENCY}>>, write:struct<iops_mean:double,bw:long,clat_ns:struct<{_LATENCY}>>, sync:struct<lat_ns:struct<{_LATENCY}>>>>"""
TEMPORARY = "incoming-"


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder without their contents (the column is pruned from the scan)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.unix_micros("modificationTime").alias("mod_us"))


def object_tree(spark: SparkSession, root: str) -> DataFrame:
    """(ns, key, size, mod_ns) of the objects under <root>/<ns>/<k[0:2]>/<k[2:4]>/<key>; files whose names are no keys are passed over."""
    files = _listing(spark, root)
    ns = F.element_at(F.split("path", "/"), -4)
    return files.where(valid_key(F.col("name")) & ns.isin(*NAMESPACES)).select(ns.alias("ns"), F.col("name").alias("key"), F.col("length").alias("size"), (F.col("mod_us") * 1000).alias("mod_ns"))


def temporary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Number and bytes of writes that were left unfinished."""
    left = _listing(spark, folder).where(F.col("name").startswith(TEMPORARY))
    return left.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(ns, key, content) of the objects under root, for verification."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    return files.where(valid_key(F.element_at(parts, -1))).select(F.element_at(parts, -4).alias("ns"), F.element_at(parts, -1).alias("key"), "content")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """What ingest.store has written under folder: ns, shard (a key's first two digits), key, content, size."""
    return spark.read.schema("key string, content binary, size long, ns string, shard string").parquet(folder)


def output_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, digest) of a build's outputs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), sha256_hex(F.col("content")).alias("digest"))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCESS_LOG).json(path).where("msg = 'request'")


def access_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ACCESS_LOG).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("msg = 'request'")


def write_access_log(requests: DataFrame, path: str) -> None:
    requests.write.mode("append").json(path)


def parse_stats(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows with the nodes' /stats bodies parsed; what a body lacks is null."""
    return rows.withColumn("stats", F.from_json(column, T.StructType.fromDDL(STATS)))


def eviction_totals(stats: DataFrame) -> DataFrame:
    """Evictions of all nodes, and whether any node is over its high-water mark."""
    total = lambda c, n: F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("long").alias(n)
    out = stats.agg(total("stats.eviction.evicted", "objects_evicted"), total("stats.eviction.bytes_reclaimed", "bytes_reclaimed"), F.coalesce(F.bool_or("stats.usage.over_high_water"), F.lit(False)).alias("any_over_high_water"))
    return out.withColumn("observed", F.col("objects_evicted") > 0)


def metrics_text(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of an exposition file; comments and lines that are no metric are passed over."""
    return parse_metrics(spark.read.text(path), F.col("value"))


def parse_metrics(rows: DataFrame, line: Column) -> DataFrame:
    name, value = split_metric(line)
    kept = rows.where(~line.startswith("#") & (F.trim(line) != ""))
    return kept.select(name.alias("name"), value.alias("metric_value")).where("metric_value IS NOT NULL")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long-form metrics (name, labels map, value) in the exposition format, labels by name; backslashes, quotes and line feeds in their values are escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    metrics.select(F.concat_ws(" ", F.concat("name", labels), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(df: DataFrame, folder: str, stamp: str, smoke: bool = False) -> list[str]:
    """Writes a report under its time and, unless it is a smoke run, as the latest."""
    paths = [f"{folder}/{stamp}"] + [f"{folder}/latest"] * (not smoke)
    for p in paths:
        df.write.mode("overwrite").json(p)
    return paths


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def markdown_tables(df: DataFrame, by: str, order: str) -> DataFrame:
    """(by, markdown): a section for each scenario, its rows in order. A report has a bounded number of rows."""
    shown = [c for c in df.columns if c != by]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in shown]), F.lit(" |"))
    head = "| " + " | ".join(shown) + " |\n|" + "---:|" * len(shown)
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), cells.alias("line")))).alias("r"))
    return rows.select(by, F.concat(F.lit("### `"), F.col(by), F.lit("`\n\n" + head + "\n"), F.array_join("r.line", "\n")).alias("markdown"))


def markdown_table(df: DataFrame, order: str) -> DataFrame:
    """A report (a bounded number of rows) as one Markdown table in one row."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order), cells.alias("line")))).alias("r"))
    return rows.select(F.concat(F.lit(head + "\n"), F.array_join("r.line", "\n")).alias("markdown"))


def build_events(spark: SparkSession, path: str) -> DataFrame:
    """A build's events, one file of bounded size, with `seq`, their place in it."""
    return spark.read.schema(BUILD_EVENT).json(path).coalesce(1).withColumn("seq", F.monotonically_increasing_id())


def runner_counts(events: DataFrame, seq: str) -> DataFrame:
    """What a build's last metrics event says of its actions, 0 where it says nothing. seq orders the events."""
    last = events.where("buildMetrics IS NOT NULL").agg(F.max_by("buildMetrics.actionSummary.runnerCount", seq).alias("rc"))
    counts = F.coalesce("rc", F.array().cast("array<struct<name:string,count:long>>"))
    total = lambda keep: F.aggregate(F.filter(counts, keep), F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return last.select(
        total(lambda x: x["name"] == "remote cache hit").alias("remote_cache_hits"),
        total(lambda x: x["name"].rlike("linux-sandbox|local|processwrapper|worker")).alias("locally_executed"),
        total(lambda x: x["name"] == "internal").alias("internal_actions"),
        total(lambda x: x["name"] == "total").alias("total_actions"),
    )


def fio_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One row a job; a percentile that a job lacks is null."""
    jobs = report(spark, path, FIO).select(F.explode("jobs").alias("j"))
    at = lambda kind, part, p: F.try_element_at(F.col(f"j.{kind}.{part}.percentile"), F.lit(f"{p}.000000")).alias(f"{kind}_lat_ns_p{p}")
    return jobs.select(
        F.col("j.jobname").alias("name"), F.col("j.read.iops_mean").alias("read_iops_mean"), F.col("j.read.bw").alias("read_bw_kib_s"), at("read", "clat_ns", 50), at("read", "clat_ns", 99),
        F.col("j.write.iops_mean").alias("write_iops_mean"), F.col("j.write.bw").alias("write_bw_kib_s"), at("write", "clat_ns", 50), at("write", "clat_ns", 99), at("sync", "lat_ns", 50), at("sync", "lat_ns", 99),
    )


def host_facts(spark: SparkSession, facts: dict[str, str | int | float | bool | None]) -> DataFrame:
    """One row of what is known of a host, as text by name."""
    return spark.createDataFrame([({k: None if v is None else str(v) for k, v in facts.items()},)], "host map<string,string>")
