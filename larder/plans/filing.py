"""Queries over files and streams: what stores, tools and nodes write is made of the tables' rows, written to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.functions.hashing import sha256_hex
from larder.operators import index as I
from larder.operators import ingest, placement, repair, reports
from larder.operators import requests as Q
from larder.operators.lineage import scratch
from larder.plans import indexing, reporting
from larder.plans.base import RUN_SECONDS, SQL_ACCESSES, SQL_CONTENTS, SQL_OBJECTS, SQL_PLACED, SQL_REQUESTS, accesses, cluster, contents, holdings, micros, objects, requests, table
from larder.sources import files, generators
from larder.streaming import store

LIMIT = 8_192


def _nations(spark: SparkSession, sf: str) -> list:
    """Nations are few at every scale, so the driver writes a file or a line of each."""
    return table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()


def _tree(spark: SparkSession, sf: str) -> str:
    """A store's tree with an object of each nation's name, an unfinished write beside each third, and a foreign file."""
    import hashlib

    root = scratch(spark, "tree")
    for r in _nations(spark, sf):
        body = r["n_name"].encode()
        key = hashlib.sha256(body).hexdigest()
        at = f"{root}/{('cas', 'ac')[r['n_nationkey'] % 2]}/{key[:2]}/{key[2:4]}"
        files.write_bytes(spark, f"{at}/{key}", body)
        if r["n_nationkey"] % 3 == 0:
            files.write_bytes(spark, f"{at}/{files.TEMPORARY}{r['n_nationkey']}", body * 2)
    files.write_bytes(spark, f"{root}/cas/readme.txt", b"no object")
    return root


def object_tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.object_tree(spark, _tree(spark, sf)).select("ns", "key", "size", (F.col("mod_ns") > 0).alias("dated"))


def temp_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return files.temporary_files(spark, _tree(spark, sf))


def output_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Names and digests of files named by nations, whose contents are the names as well."""
    folder = scratch(spark, "outputs")
    for r in _nations(spark, sf):
        files.write_bytes(spark, f"{folder}/{r['n_nationkey'] % 4}/{r['n_name']}.out", r["n_name"].encode())
    return files.output_digests(spark, folder)


def put_sink(spark: SparkSession, sf: str) -> DataFrame:
    """What a batch of writes leaves in the store, read back: documents of up to LIMIT bytes under their digests, each ninth twice, some under a wrong digest."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    twice = docs.select(F.explode(F.when(F.col("doc_id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("turn"), "doc_id", "content")
    key = F.when(F.col("doc_id") % 10 == 3, sha256_hex(F.col("doc_id").cast("string").cast("binary"))).otherwise(sha256_hex(F.col("content")))
    writes = twice.select((F.col("doc_id") * 2 + F.col("turn")).alias("seq"), F.lit("cas").alias("ns"), key.alias("key"), "content", F.octet_length("content").cast("long").alias("declared"))
    folder = scratch(spark, "store")
    ingest.store(writes, spark.createDataFrame([], "ns string, key string"), LIMIT, folder)
    return files.stored(spark, folder).select("ns", "shard", "key", "size", (sha256_hex(F.col("content")) == F.col("key")).alias("intact"))


def stat_touch(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups of what the accesses name: how many found their object, its bytes, and the accesses that come of them."""
    found, touches = I.stat(objects(spark, sf), accesses(spark, sf))
    seen = I.flush_touches(objects(spark, sf), touches)
    totals = found.groupBy("ns").agg(F.count("*").alias("lookups"), F.sum("size").alias("bytes"))
    return totals.join(seen.groupBy("ns").agg(F.max("last_access_ns").alias("latest_ns"), F.sum("access_count").alias("accesses")), "ns")


_REPORT = "kind string, setup struct<nodes:int,seed:long,smoke:boolean>, scenarios array<struct<name:string,runs:long,run:long,operations:long,errors:long,misses:long,bytes:long,ops_per_sec:double,ops_per_sec_min:double,ops_per_sec_max:double,mib_per_sec:double,p50_ms:double,p95_ms:double,p99_ms:double,p999_ms:double>>"


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    rates = Q.run_rates(requests(spark, sf), F.lit(RUN_SECONDS), "op", "run")
    return rates.join(Q.latency_summary(requests(spark, sf), "op", "run").drop("count"), ["op", "run"])


def bench_report(spark: SparkSession, sf: str) -> DataFrame:
    """Put together, written as a run and as the latest, and read back; a smoke run after it leaves the latest as it was."""
    folder = scratch(spark, "reports")
    files.write_report(reports.bench_report(_bench(spark, sf), "op", {"nodes": 3, "seed": 42, "smoke": False}), folder, "20240101T000000Z")
    smoke = reports.bench_report(_bench(spark, sf).where("op = 'put'"), "op", {"nodes": 1, "seed": 42, "smoke": True})
    files.write_report(smoke, folder, "20240102T000000Z", smoke=True)
    r = files.report(spark, f"{folder}/latest", _REPORT)
    return r.select("kind", "setup.nodes", "setup.smoke", F.explode("scenarios").alias("s")).select("kind", "nodes", "smoke", "s.*")


def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A bench report read back and rendered."""
    folder = scratch(spark, "reports")
    files.write_report(reports.bench_report(_bench(spark, sf), "op", {"nodes": 3, "seed": 42, "smoke": False}), folder, "20240101T000000Z")
    return reports.bench_markdown(files.report(spark, f"{folder}/latest", _REPORT), ("run", "operations", "errors", "misses", "bytes"))


def memory_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as scenarios, by their largest object."""
    rows = table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("scenario")).agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("object_bytes"), F.count("*").alias("peak_mib"))
    return files.markdown_table(rows.select("scenario", "object_bytes", "peak_mib"), "object_bytes")


def scenario_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A table a scenario, its runs by the bytes that they moved."""
    rows = Q.run_rates(requests(spark, sf), F.lit(RUN_SECONDS), "op", "run").select("op", "run", "operations", "errors", "misses", "bytes")
    return files.markdown_tables(rows, "op", "bytes")


def metrics_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Derived metrics written in the exposition format and read back."""
    folder = scratch(spark, "metrics")
    files.write_metrics(reporting.metric_series(spark, sf), folder)
    return files.metrics_text(spark, folder)


def build_events(spark: SparkSession, sf: str) -> DataFrame:
    """Actions by runner in the last metrics event of a build with an event for each nation, each third with metrics."""
    lines = []
    for r in _nations(spark, sf):
        n = r["n_nationkey"]
        counts = [{"name": name, "count": k} for name, k in (("total", 100 + n), ("remote cache hit", 50 + n), ("linux-sandbox", n % 7), ("worker", n % 5), ("internal", n % 11))]
        lines.append({"id": {"buildMetrics": {}}, "buildMetrics": {"actionSummary": {"runnerCount": counts}}} if n % 3 == 0 else {"id": {}})
    path = f"{scratch(spark, 'build')}/events.json"
    files.write_bytes(spark, path, "\n".join(map(json.dumps, lines)).encode())
    return files.runner_counts(files.build_events(spark, path), "seq")


def fio_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A device report with a job for each nation; odd ones have no 99th percentile."""
    jobs = []
    for r in _nations(spark, sf):
        n = r["n_nationkey"]
        at = {"50.000000": n * 10} | ({"99.000000": n * 100} if n % 2 == 0 else {})
        jobs.append({"jobname": r["n_name"], "read": {"iops_mean": n + 0.5, "bw": n * 4, "clat_ns": {"percentile": at}}, "write": {"iops_mean": n * 2.0, "bw": n}, "sync": {"lat_ns": {"percentile": at}}})
    path = f"{scratch(spark, 'fio')}/fio.json"
    files.write_bytes(spark, path, json.dumps({"fio version": "fio-3", "jobs": jobs}, indent=1).encode())
    return files.fio_jobs(spark, path)


def host_facts(spark: SparkSession, sf: str) -> DataFrame:
    return files.host_facts(spark, {"cpus": 8, "memory_gib": 32.5, "container": True, "model": None}).select(F.explode("host").alias("fact", "value"))


def corpus_keys(spark: SparkSession, sf: str) -> DataFrame:
    return generators.corpus(spark, "bench", 64, 100, 7).select("id", "key", F.octet_length("content").alias("size"))


def layered_graph(spark: SparkSession, sf: str) -> DataFrame:
    return generators.layered_graph(spark, 280, 8, 3, 1)


def mixed_operations(spark: SparkSession, sf: str) -> DataFrame:
    return generators.mixed_operations(spark, 2_000, 100, 5)


_SETTINGS = (
    (1, "node-a", ":8080", "/data", 100, 10, 2, 0.9, 0.7, 4, 16), (2, " ", "", "", 0, -1, 0, 1.5, 0.7, -1, 0), (3, "node-x", ":8080", "/data", 100, 10, 9, 0.9, 0.9, 4, 16),
    (4, "node-b", ":8080", "/data", 1, 1, 1, 1.0, 0.5, 0, 1), (5, "node-a", ":8080", " ", 100, 0, 3, 0.0, -0.1, 4, 16),
)


def config_problems(spark: SparkSession, sf: str) -> DataFrame:
    peers = [("node-a", "http://a:1"), ("node-b", "http://b:1"), ("node-c", "https://c")]
    found = [(n, rules.Settings(name, listen, folder, most, each, copies, peers, high, low, workers, queue).problems()) for n, name, listen, folder, most, each, copies, high, low, workers, queue in _SETTINGS]
    return spark.createDataFrame([(n, "; ".join(p)) for n, p in found], "id long, problems string")


def event_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.rfc3339(F.col("ts")).alias("at"))


def _stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Accesses as files, to be taken in one batch, and a folder for what the stream keeps."""
    folder = scratch(spark, "stream")
    accesses(spark, sf).withColumn("kind", F.lit("get")).write.parquet(f"{folder}/accesses")
    return store.accesses(spark, f"{folder}/accesses", files_per_trigger=1 << 30), folder


def touch_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The index after a stream of accesses."""
    stream, folder = _stream(spark, sf)
    snapshots = store.Snapshots(spark, f"{folder}/index", objects(spark, sf))
    store.flush_touches(stream, snapshots, f"{folder}/offsets", None).awaitTermination()
    return snapshots.read(0)


def sweep_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The index after a stream of accesses and a sweep."""
    stream, folder = _stream(spark, sf)
    snapshots = store.Snapshots(spark, f"{folder}/index", objects(spark, sf))
    store.sweep(stream, snapshots, f"{folder}/offsets", indexing.quota(spark, sf), indexing.HIGH, indexing.LOW, None).awaitTermination()
    return snapshots.read(0)


def memory_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of memory each half second, of a stream of samples."""
    folder = scratch(spark, "memory")
    samples = table(spark, sf, "events").select(F.timestamp_micros(micros(F.col("ts"))).alias("ts"), F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("node"), F.floor(F.col("value") * 1024).cast("long").alias("rss_bytes"))
    samples.write.parquet(f"{folder}/samples")
    stream = spark.readStream.schema("ts timestamp, node string, rss_bytes long").parquet(f"{folder}/samples")
    peaks = store.memory_peaks(stream).writeStream.outputMode("complete")
    peaks.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/peaks")).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, node string, rss_bytes long").parquet(f"{folder}/peaks").select(F.unix_micros("start").alias("start_us"), "node", "rss_bytes")


def convergence_poll(spark: SparkSession, sf: str) -> DataFrame:
    """Probes until repair has brought back every copy that is missing."""
    nodes = spark.createDataFrame([("node-a", True), ("node-b", True), ("node-c", True)], "node string, reachable boolean")
    keys = contents(spark, sf).select("key")
    expected = repair.expected_copies(placement.holders(keys, cluster(spark), 2))
    held = [holdings(spark, sf).select("key", "node")]

    def repaired() -> None:
        held.append(held[-1].unionByName(repair.audit(expected, held[-1], nodes).where("state = 'absent'").select("key", "node")))

    return store.convergence_poll(lambda: repair.convergence(repair.replica_classes(keys, held[-1], nodes)), 5, repaired)


def repair_loop(spark: SparkSession, sf: str) -> DataFrame:
    """All passes of an audit over the index, with a cursor kept between them."""
    ours = placement.holds(contents(spark, sf).select("key"), cluster(spark), "node-a", 2)
    return repair.audit_loop(contents(spark, sf).withColumn("ns", F.lit("cas")), ours, scratch(spark, "audit"), 1 << 30, repair.PAGE, repair.PAGE)


_NAMES = (object_tree_scan, temp_sweep, output_digests, put_sink, stat_touch, bench_report, report_markdown, scenario_markdown, memory_markdown, metrics_sink, build_events, fio_jobs, host_facts, corpus_keys, layered_graph, mixed_operations, config_problems, event_times, touch_stream, sweep_stream, memory_stream, convergence_poll, repair_loop)
QUERIES = {f.__name__: f for f in _NAMES}

_BLOCKS = " || ".join(f"sha256('bench/7/' || i || '/{n}')" for n in range(4))
_DRAWN = "CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
_U = "(" + _DRAWN.format(x="'5/{n}/' || i") + " % 1000003) / 1000003.0"
_POINTS = ", ".join(f"coalesce(floor(quantile_disc(latency_ns, {q}) / 1000) / 1000, 0.0) AS {n}" for n, q in Q.PERCENTILES.items() if n != "p90_ms")
_PROBLEMS = (
    ("trim(name) = ''", "node name is empty"), ("trim(listen) = ''", "listen address is empty"), ("trim(folder) = ''", "data directory is empty"), ("most <= 0", "max bytes is not positive"), ("each <= 0", "max object bytes is not positive"),
    ("NOT (0 < high AND high <= 1)", "high water is outside (0, 1]"), ("NOT (0 < low AND low < high)", "low water is outside (0, high water)"), ("copies < 1", "replica count is below 1"), ("copies > 3", "replica count exceeds the cluster"),
    ("workers < 0", "repair workers is negative"), ("queue < 1", "repair queue is below 1"), ("name NOT IN ('node-a', 'node-b', 'node-c')", "the node is not among the peers"),
)
_SQL_TOUCHED = indexing.ORACLES["touch_flush"]

ORACLES = {
    "object_tree_scan": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'cas' ELSE 'ac' END AS ns, sha256(n_name) AS key, CAST(strlen(n_name) AS BIGINT) AS size, true AS dated FROM nation",
    "temp_sweep": "SELECT count(*) AS files, CAST(sum(2 * strlen(n_name)) AS BIGINT) AS bytes FROM nation WHERE n_nationkey % 3 = 0",
    "output_digests": "SELECT n_name || '.out' AS name, sha256(n_name) AS digest FROM nation",
    "put_sink": f"SELECT DISTINCT 'cas' AS ns, substr(sha256(text), 1, 2) AS shard, sha256(text) AS key, CAST(strlen(text) AS BIGINT) AS size, true AS intact FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND doc_id % 10 <> 3 AND strlen(text) <= {LIMIT}",
    "stat_touch": f"WITH {SQL_OBJECTS}, {SQL_ACCESSES}, t AS ({_SQL_TOUCHED}), l AS (SELECT o.ns, count(*) AS lookups, CAST(sum(o.size) AS BIGINT) AS bytes FROM accesses a JOIN objects o ON a.ns = o.ns AND a.key = o.key GROUP BY o.ns) SELECT l.*, x.latest_ns, x.accesses FROM l JOIN (SELECT ns, max(last_access_ns) AS latest_ns, CAST(sum(access_count) AS BIGINT) AS accesses FROM t GROUP BY ns) x ON l.ns = x.ns",
    "bench_report": f"""WITH {SQL_REQUESTS}, x AS (SELECT op, run, count(*) AS operations, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND status = 404) AS misses, CAST(coalesce(sum(bytes) FILTER (error IS NULL AND status <> 404), 0) AS BIGINT) AS bytes,
  count(*) / CAST({RUN_SECONDS} AS DOUBLE) AS ops_per_sec, CAST(coalesce(sum(bytes) FILTER (error IS NULL AND status <> 404), 0) AS DOUBLE) / {RUN_SECONDS} / 1048576 AS mib_per_sec, {_POINTS} FROM requests GROUP BY op, run),
y AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ops_per_sec, run) - 1 AS i, count(*) OVER (PARTITION BY op) AS runs, min(ops_per_sec) OVER (PARTITION BY op) AS ops_per_sec_min, max(ops_per_sec) OVER (PARTITION BY op) AS ops_per_sec_max FROM x)
SELECT 'benchmark' AS kind, CAST(3 AS INTEGER) AS nodes, false AS smoke, op AS name, * EXCLUDE (op, i) FROM y WHERE i = runs // 2""",
    "report_markdown": f"""WITH {SQL_REQUESTS}, x AS (SELECT op, run, count(*) AS operations, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND status = 404) AS misses, CAST(coalesce(sum(bytes) FILTER (error IS NULL AND status <> 404), 0) AS BIGINT) AS bytes FROM requests GROUP BY op, run),
y AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY operations, run) - 1 AS i, count(*) OVER (PARTITION BY op) AS runs FROM x), n AS (SELECT chr(10) AS n)
SELECT '# Benchmarks' || n || n || '## Setup' || n || n || '| | |' || n || '|---|---|' || n || '| nodes | 3 |' || n || '| seed | 42 |' || n || '| smoke | false |' || n || n || '## Results' || n || n
  || string_agg('### `' || op || '`' || n || n || '| runs | run | operations | errors | misses | bytes |' || n || '|---:|---:|---:|---:|---:|---:|' || n || '| ' || runs || ' | ' || run || ' | ' || operations || ' | ' || errors || ' | ' || misses || ' | ' || bytes || ' |', chr(10) || chr(10) ORDER BY op) AS markdown FROM y, n WHERE i = runs // 2 GROUP BY n""",
    "memory_markdown": """WITH x AS (SELECT coalesce(source, 'none') AS scenario, CAST(coalesce(max(strlen(text)), 0) AS BIGINT) AS object_bytes, count(*) AS peak_mib FROM documents GROUP BY 1)
SELECT '| scenario | object_bytes | peak_mib |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || scenario || ' | ' || object_bytes || ' | ' || peak_mib || ' |', chr(10) ORDER BY object_bytes, '| ' || scenario || ' | ' || object_bytes || ' | ' || peak_mib || ' |') AS markdown FROM x""",
    "scenario_markdown": f"""WITH {SQL_REQUESTS}, x AS (SELECT op, run, count(*) AS operations, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND status = 404) AS misses, CAST(coalesce(sum(bytes) FILTER (error IS NULL AND status <> 404), 0) AS BIGINT) AS bytes FROM requests GROUP BY op, run)
SELECT op, '### `' || op || '`' || chr(10) || chr(10) || '| run | operations | errors | misses | bytes |' || chr(10) || '|---:|---:|---:|---:|---:|' || chr(10) || string_agg('| ' || run || ' | ' || operations || ' | ' || errors || ' | ' || misses || ' | ' || bytes || ' |', chr(10) ORDER BY bytes, '| ' || run) AS markdown FROM x GROUP BY op""",
    "metrics_sink": f"SELECT name, value AS metric_value FROM ({reporting.ORACLES['derived_metrics']})",
    "build_events": "SELECT CAST(50 + n AS BIGINT) AS remote_cache_hits, CAST(n % 7 + n % 5 AS BIGINT) AS locally_executed, CAST(n % 11 AS BIGINT) AS internal_actions, CAST(100 + n AS BIGINT) AS total_actions FROM (SELECT max(n_nationkey) AS n FROM nation WHERE n_nationkey % 3 = 0)",
    "fio_jobs": """SELECT n_name AS name, n_nationkey + CAST(0.5 AS DOUBLE) AS read_iops_mean, CAST(n_nationkey * 4 AS BIGINT) AS read_bw_kib_s, CAST(n_nationkey * 10 AS DOUBLE) AS read_lat_ns_p50, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 100 END AS DOUBLE) AS read_lat_ns_p99,
CAST(n_nationkey * 2 AS DOUBLE) AS write_iops_mean, CAST(n_nationkey AS BIGINT) AS write_bw_kib_s, CAST(NULL AS DOUBLE) AS write_lat_ns_p50, CAST(NULL AS DOUBLE) AS write_lat_ns_p99, CAST(n_nationkey * 10 AS DOUBLE) AS sync_lat_ns_p50, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 100 END AS DOUBLE) AS sync_lat_ns_p99 FROM nation""",
    "host_facts": "SELECT * FROM (VALUES ('cpus', '8'), ('memory_gib', '32.5'), ('container', 'True'), ('model', NULL)) t(fact, value)",
    "corpus_keys": f"SELECT i AS id, sha256(unhex(substr({_BLOCKS}, 1, 200))) AS key, CAST(100 AS INTEGER) AS size FROM range(64) t(i)",
    "layered_graph": f"""WITH l AS (SELECT i AS target, i * 8 // 280 AS layer FROM range(280) t(i)), w AS (SELECT target, CAST(ceil((layer - 1) * 280 / 8) AS BIGINT) AS first, CAST(ceil(layer * 280 / 8) - ceil((layer - 1) * 280 / 8) AS BIGINT) AS width FROM l WHERE layer > 0)
SELECT DISTINCT target, first + {_DRAWN.format(x="'1/' || target || '/' || k")} % width AS dep FROM w CROSS JOIN range(3) g(k) WHERE width > 0""",
    "mixed_operations": f"SELECT id, op, CASE WHEN op <> 'miss' THEN o END AS object FROM (SELECT i AS id, CASE WHEN {_U.format(n=1)} < 0.8 THEN CASE WHEN {_U.format(n=2)} < 0.2 THEN 'miss' ELSE 'get' END ELSE 'put' END AS op, {_DRAWN.format(x=chr(39) + '5/3/' + chr(39) + ' || i')} % 100 AS o FROM range(2000) t(i))",
    "config_problems": f"SELECT CAST(id AS BIGINT) AS id, concat_ws('; ', {', '.join(f'CASE WHEN {w} THEN {chr(39)}{p}{chr(39)} END' for w, p in _PROBLEMS)}) AS problems FROM (VALUES {', '.join(map(str, _SETTINGS))}) t(id, name, listen, folder, most, each, copies, high, low, workers, queue)",
    "event_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events",
    "touch_stream": _SQL_TOUCHED,
    "sweep_stream": f"{indexing.victims_sql()} SELECT * FROM touched t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.ns = t.ns AND v.key = t.key)",
    "memory_stream": "SELECT epoch_us(ts) // 500000 * 500000 AS start_us, 'node-' || user_id % 3 AS node, CAST(max(floor(value * 1024)) AS BIGINT) AS rss_bytes FROM events GROUP BY 1, 2",
    "convergence_poll": f"WITH {SQL_CONTENTS} SELECT count(*) AS \"full\", CAST(0 AS BIGINT) AS under, CAST(0 AS BIGINT) AS absent, CAST(0 AS BIGINT) AS unreadable, true AS converged FROM contents",
    "repair_loop": SQL_PLACED
    + f" SELECT 'cas' AS ns, c.key, c.size, CASE WHEN o.key IS NULL THEN 'not_ours' ELSE 'queued' END AS state, CAST((row_number() OVER (ORDER BY c.key) - 1) // {repair.PAGE} AS INTEGER) AS pass FROM contents c LEFT JOIN (SELECT key FROM ranked WHERE rank <= 2 AND name = 'node-a') o ON c.key = o.key",
}
