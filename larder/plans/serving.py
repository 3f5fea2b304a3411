"""Repair, reads, writes, and what requests look like: queries over contents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.functions.hashing import sha256_hex
from larder.operators import placement as P
from larder.operators import repair as R
from larder.operators import requests as Q
from larder.plans.base import RUN_SECONDS, SQL_OBJECTS, SQL_PLACED, SQL_REQUESTS, cluster, contents, holdings, node_state, objects, requests, table


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    return R.expected_copies(P.holders(contents(spark, sf).select("key"), cluster(spark), 2))


def repair_audit(spark: SparkSession, sf: str) -> DataFrame:
    return R.audit(_expected(spark, sf), holdings(spark, sf), node_state(spark))


def repair_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return R.repair_tasks(_expected(spark, sf), holdings(spark, sf), node_state(spark), "node-a")


def repair_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first 16 of a pass."""
    return R.queued(repair_tasks(spark, sf), ["key", "node"], 16)


def replica_convergence(spark: SparkSession, sf: str) -> DataFrame:
    return R.convergence(R.replica_classes(contents(spark, sf), holdings(spark, sf), node_state(spark)))


def replica_classes(spark: SparkSession, sf: str) -> DataFrame:
    return R.replica_classes(contents(spark, sf), holdings(spark, sf), node_state(spark))


def replica_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At most 2,000 refused keys and then acknowledged ones up to 3,000, each by a stride through the sorted keys."""
    keys = objects(spark, sf).select("key")
    refused, acked = keys.where("substr(key, 1, 1) < '6'"), keys.where("substr(key, 1, 1) >= '6'")
    first = R.subsample(refused, "key", 2_000, refused.count())
    return first.unionByName(R.subsample(acked, "key", 3_000 - first.count(), acked.count()))


def read_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of every key on every node, as a client's and as another node's."""
    hops = spark.createDataFrame([("",), ("read",)], "hop string")
    nodes = node_state(spark).select("node")
    reads = contents(spark, sf).select("key").crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(hops))
    c = cluster(spark)
    return R.read_source(reads, P.ranked(contents(spark, sf).select("key"), c), holdings(spark, sf), node_state(spark))


def put_ack_outcome(spark: SparkSession, sf: str) -> DataFrame:
    held = P.holders(contents(spark, sf).select("key"), cluster(spark), 2)
    return R.acknowledgements(held, node_state(spark))


def hop_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """What each node does with a write of each role, at two levels of usage and where it knows none."""
    hops = spark.createDataFrame([(h,) for h in ("", "coordinator", "replica", "repair", "read")], "hop string")
    used = spark.createDataFrame([(50,), (150,), (None,)], "used long")
    keys = contents(spark, sf).select("key")
    ours = P.holds(keys, cluster(spark), "node-b", 2).withColumn("holds", F.lit(True))
    rows = keys.join(ours, "key", "left").crossJoin(F.broadcast(hops)).crossJoin(F.broadcast(used))
    action = rules.hop_dispatch(F.col("hop"), F.coalesce("holds", F.lit(False)), F.col("used"), F.lit(100))
    return rows.groupBy("hop", "used", action.alias("action")).agg(F.count("*").alias("keys"))


def hop_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("", "coordinator", "replica", "repair", "read", "newer"))), (F.col("event_id") % 6 + 1).cast("int")).alias("header"), F.when(F.col("user_id") % 2 == 0, "node-a").alias("forwarded_by"))
    hop = rules.inbound_hop(F.col("forwarded_by"), F.col("header"))
    return rows.select("event_id", hop.alias("hop"), rules.terminal(hop).alias("terminal"), rules.forwarded(hop).alias("forwarded"))


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latency_summary(requests(spark, sf).where("error IS NULL"), "op")


def latency_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latency_summary(requests(spark, sf).where("error IS NULL"))


def latency_summary_empty(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latency_summary(requests(spark, sf).where("latency_ns < 0"))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latency_histogram(requests(spark, sf), "op", "ns")


def run_rates(spark: SparkSession, sf: str) -> DataFrame:
    return Q.run_rates(requests(spark, sf), F.lit(RUN_SECONDS), "run")


def measured_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rates without the first hour of each day and without requests that the end of the day cut off."""
    day = 86_400_000_000
    rows = requests(spark, sf).withColumn("in_day", F.col("ts_us") % day)
    kept = rows.where((F.col("in_day") >= 3_600_000_000) & ~((F.col("error").isNotNull()) & (F.col("in_day") * 1000 + F.col("latency_ns") >= day * 1000)))
    return Q.run_rates(kept, F.lit(RUN_SECONDS - 3_600), "op")


def median_run(spark: SparkSession, sf: str) -> DataFrame:
    return Q.median_run(run_rates(spark, sf))


def interp_median(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolated medians of cold (even runs) and warm (odd runs) operations per run, and what that saves."""
    runs = run_rates(spark, sf).groupBy((F.col("run") % 2 == 0).alias("cold")).agg(F.percentile("operations", 0.5).alias("median"), F.min("operations").alias("min"), F.max("operations").alias("max"))
    one = runs.agg(F.max(F.when(F.col("cold"), F.col("median"))).alias("cold"), F.max(F.when(~F.col("cold"), F.col("median"))).alias("warm"), F.max("max").alias("most"), F.min("min").alias("least"))
    saved, speedup = Q.reduction(F.col("cold"), F.col("warm"))
    return one.select("cold", "warm", "least", "most", saved.alias("reduction"), speedup.alias("speedup"))


def request_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.request_counts(requests(spark, sf))


def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    return Q.in_flight_peak(requests(spark, sf).withColumn("latency_ns", F.col("latency_ns") * 10_000), "op")


def hop_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.hop_counts(requests(spark, sf))


def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf).where("error IS NOT NULL")
    return rows.groupBy(rules.error_class(F.col("error")).alias("class")).agg(F.count("*").alias("errors"))


def log_levels(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).groupBy(rules.log_level(F.col("status")).alias("level")).agg(F.count("*").alias("requests"))


def error_samples(spark: SparkSession, sf: str) -> DataFrame:
    return Q.error_samples(requests(spark, sf))


def retries(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf)
    return rows.groupBy("status", rules.retryable(F.col("status")).alias("retryable")).agg(F.count("*").alias("requests"))


def peak_rss(spark: SparkSession, sf: str) -> DataFrame:
    """Events as memory samples of their users' nodes; MiB over all nodes is the highest of them."""
    samples = requests(spark, sf).select("hop", F.col("start_ns").alias("ts_ns"), (F.col("bytes") * 1024).alias("rss_bytes"), F.col("seq").alias("goroutines")).withColumnRenamed("hop", "node")
    return Q.peak_rss(samples)


def props_metric_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Props as JSON with a schema, then as exposition lines parsed back."""
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    line = F.concat(F.lit('store_k{node="'), F.col("event_id").cast("string"), F.lit('"} '), F.col("p.k").cast("string"))
    name, value = text.split_metric(line)
    return rows.select("event_id", name.alias("name"), value.alias("metric_value"), text.as_long(F.col("p.k").cast("string")).alias("as_long"))


def http_statuses(spark: SparkSession, sf: str) -> DataFrame:
    errors = [None, "not_found", "bad_key", "bad_namespace", "closed", "canceled", "deadline_exceeded", "digest_mismatch", "too_large", "over_quota", "short_write", "insufficient_replicas", "upload_interrupted", "other"]
    rows = spark.createDataFrame([(e, a) for e in errors for a in (True, False)], "error string, already_stored boolean")
    return rows.select("error", "already_stored", rules.get_status(F.col("error")).alias("get_status"), rules.put_status(F.col("error"), F.col("already_stored")).alias("put_status"), rules.declined_over_quota(F.lit(None).cast("int"), F.col("error")).alias("declined"))


def op_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in ("GET", "HEAD", "PUT", "POST", "DELETE", "get")], "method string")
    return rows.select("method", rules.op_name(F.col("method")).alias("op"))


def store_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each node's store in long form, from requests dealt to nodes by their keys' digests."""
    rows = requests(spark, sf).withColumn("node", F.element_at(F.array(*map(F.lit, ("node-a", "node-b", "node-c"))), (F.conv(F.substring(sha256_hex(F.col("seq").cast("string")), 1, 6), 16, 10).cast("long") % 3 + 1).cast("int")))
    ok = F.col("error").isNull()
    put, get = F.col("op") == "put", F.col("op") != "put"
    wide = rows.groupBy("node").agg(
        F.count_if(put & ok).alias("puts_total"), F.count_if(put & ~ok).alias("puts_rejected_total"), F.count_if(get & ok & (F.col("status") == 200)).alias("hits_total"), F.count_if(get & ok & (F.col("status") == 404)).alias("misses_total"),
        F.coalesce(F.sum(F.when(put & ok, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_in_total"), F.coalesce(F.sum(F.when(get & ok & (F.col("status") == 200), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_out_total"),
    )
    names = [c for c in wide.columns if c != "node"]
    return wide.unpivot(["node"], names, "metric", "counter")


def access_log_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as access-log records."""
    return requests(spark, sf).select("seq", rules.log_level(F.col("status")).alias("level"), "op", "status", text.milliseconds(F.col("latency_ns")).alias("duration_ms"), F.when(F.col("hop") == "", "").otherwise("peer").alias("forwarded_by"))


_NAMES = (repair_audit, repair_tasks, repair_queue, replica_convergence, replica_classes, replica_sample, read_fallback, put_ack_outcome, hop_dispatch, hop_rules, latency_summary, latency_summary_all, latency_summary_empty, latency_histogram, run_rates, measured_window, median_run, interp_median, request_counts, in_flight, hop_counts, error_classes, log_levels, error_samples, retries, peak_rss, props_metric_parse, http_statuses, op_names, store_counters, access_log_fields)
QUERIES = {f.__name__: f for f in _NAMES}

_R = f"WITH {SQL_REQUESTS} "
_EXPECTED = ", expected AS (SELECT key, name AS node FROM ranked WHERE rank <= 2), audited AS (SELECT e.key, e.node, CASE WHEN NOT n.reachable THEN 'unreachable' WHEN h.key IS NOT NULL THEN 'present' ELSE 'absent' END AS state FROM expected e JOIN nodes n ON e.node = n.node LEFT JOIN holdings h ON e.key = h.key AND e.node = h.node) "
_TASKS = "SELECT key, node FROM audited WHERE state = 'absent' AND node <> 'node-a' AND key IN (SELECT key FROM expected WHERE node = 'node-a') AND key IN (SELECT key FROM holdings WHERE node = 'node-a')"
_CLASSES = "SELECT c.key, count(*) FILTER (n.reachable AND h.key IS NOT NULL) AS copies, count(*) FILTER (NOT n.reachable) AS errors, CASE WHEN count(*) FILTER (NOT n.reachable) = count(*) THEN 'unreadable' WHEN count(*) FILTER (n.reachable AND h.key IS NOT NULL) >= 2 THEN 'full' WHEN count(*) FILTER (n.reachable AND h.key IS NOT NULL) = 0 THEN 'absent' ELSE 'under' END AS class FROM contents c CROSS JOIN nodes n LEFT JOIN holdings h ON h.key = c.key AND h.node = n.node GROUP BY c.key"
_MS = "floor({x} / 1000) / 1000"


def _summary(by: str, where: str) -> str:
    p = ", ".join(f"coalesce({_MS.format(x=f'quantile_disc(latency_ns, {q})')}, 0.0) AS {n}" for n, q in Q.PERCENTILES.items())
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"{_R} SELECT {head}count(*) AS count, coalesce({_MS.format(x='min(latency_ns)')}, 0.0) AS min_ms, coalesce({_MS.format(x='CAST(sum(latency_ns) // nullif(count(*), 0) AS BIGINT)')}, 0.0) AS mean_ms, {p}, coalesce({_MS.format(x='max(latency_ns)')}, 0.0) AS max_ms FROM requests WHERE {where}{group}"


_RATES = "SELECT {by}, count(*) AS operations, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND status = 404) AS misses, CAST(coalesce(sum(bytes) FILTER (error IS NULL AND status <> 404), 0) AS BIGINT) AS bytes, count(*) / CAST({s} AS DOUBLE) AS ops_per_sec, CAST(coalesce(sum(bytes) FILTER (error IS NULL AND status <> 404), 0) AS DOUBLE) / {s} / 1048576 AS mib_per_sec, count(*) FILTER (error IS NOT NULL) / CAST(count(*) AS DOUBLE) AS error_rate FROM {t} GROUP BY {by}"
_RUNS = _RATES.format(by="run", s=RUN_SECONDS, t="requests")
_LE = "CASE " + " ".join(f"WHEN latency_ns <= {b} THEN {b}" for b in Q.BUCKETS_NS) + " END"
_SAMPLE = "SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n, count(*) OVER () AS c FROM objects WHERE {w}) WHERE c <= {n} OR (n % (c // {n}) = 0 AND n < {n} * (c // {n}))"
_ERRORS = ("'not_found'", "'bad_key'", "'bad_namespace'", "'closed'", "'canceled'", "'deadline_exceeded'", "'digest_mismatch'", "'too_large'", "'over_quota'", "'short_write'", "'insufficient_replicas'", "'upload_interrupted'", "'other'")

ORACLES = {
    "repair_audit": SQL_PLACED + _EXPECTED + "SELECT * FROM audited",
    "repair_tasks": SQL_PLACED + _EXPECTED + _TASKS,
    "repair_queue": SQL_PLACED + _EXPECTED + _TASKS + " ORDER BY key, node LIMIT 16",
    "replica_convergence": SQL_PLACED + f"SELECT *, under = 0 AND unreadable = 0 AS converged FROM (SELECT count(*) FILTER (class = 'full') AS \"full\", count(*) FILTER (class = 'under') AS under, count(*) FILTER (class = 'absent') AS absent, count(*) FILTER (class = 'unreadable') AS unreadable FROM ({_CLASSES}))",
    "replica_classes": SQL_PLACED + _CLASSES,
    "replica_sample": f"WITH {SQL_OBJECTS}, f AS ({_SAMPLE.format(w="substr(key, 1, 1) < '6'", n=2000)}), g AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n, count(*) OVER () AS c, 3000 - (SELECT count(*) FROM f) AS w FROM objects WHERE substr(key, 1, 1) >= '6') SELECT key FROM f UNION ALL SELECT key FROM g WHERE c <= w OR (n % (c // w) = 0 AND n < w * (c // w))",
    "read_fallback": SQL_PLACED + """, reads AS (SELECT c.key, n.node, h.hop FROM contents c CROSS JOIN nodes n CROSS JOIN (VALUES (''), ('read')) h(hop)),
p AS (SELECT r.key, r.name AS peer, r.rank, n.reachable, h.key IS NOT NULL AS held FROM ranked r JOIN nodes n ON r.name = n.node LEFT JOIN holdings h ON h.key = r.key AND h.node = r.name),
x AS (SELECT d.key, d.node, d.hop, bool_or(p.peer = d.node AND p.held) AS here, min_by(p.peer, p.rank) FILTER (p.peer <> d.node AND p.reachable AND p.held AND d.hop = '') AS hit, bool_or(p.peer <> d.node AND NOT p.reachable) AS down FROM reads d JOIN p ON d.key = p.key GROUP BY ALL)
SELECT key, node, hop, CASE WHEN here THEN node ELSE hit END AS source, CASE WHEN here THEN 'local' WHEN hop = 'read' THEN 'miss' WHEN hit IS NOT NULL THEN 'peer' WHEN down THEN 'unavailable' ELSE 'miss' END AS outcome FROM x""",
    "put_ack_outcome": SQL_PLACED + "SELECT key, count(*) AS wanted, count(*) FILTER (reachable) AS copies, coalesce(string_agg(name, ',' ORDER BY rank) FILTER (reachable), '') AS holders, count(*) FILTER (reachable) = count(*) AS acknowledged FROM ranked JOIN nodes ON name = node WHERE rank <= 2 GROUP BY key",
    "hop_dispatch": SQL_PLACED + """SELECT hop, used, CASE WHEN hop = 'repair' THEN CASE WHEN coalesce(used > 100, false) THEN 'decline' ELSE 'store' END WHEN hop IN ('replica', 'read') THEN 'store' WHEN hop = 'coordinator' THEN 'coordinate'
WHEN c.key IN (SELECT key FROM ranked WHERE rank <= 2 AND name = 'node-b') THEN 'coordinate' ELSE 'proxy' END AS action, count(*) AS keys
FROM contents c CROSS JOIN (VALUES (''), ('coordinator'), ('replica'), ('repair'), ('read')) h(hop) CROSS JOIN (VALUES (CAST(50 AS BIGINT)), (150), (NULL)) u(used) GROUP BY 1, 2, 3""",
    "hop_rules": "SELECT event_id, hop, hop IN ('replica', 'read', 'repair') AS terminal, hop <> '' AS forwarded FROM (SELECT event_id, CASE WHEN user_id % 2 <> 0 THEN '' ELSE ['', 'coordinator', 'replica', 'repair', 'read', 'replica'][event_id % 6 + 1] END AS hop FROM events)",
    "latency_summary": _summary("op", "error IS NULL"),
    "latency_summary_all": _summary("", "error IS NULL"),
    "latency_summary_empty": _summary("", "latency_ns < 0"),
    "latency_histogram": _R + f", o AS (SELECT op, ns, {_LE} AS le_ns, count(*) AS n FROM requests GROUP BY ALL), b AS (SELECT unnest([{', '.join(map(str, Q.BUCKETS_NS))}, NULL]) AS le_ns), e AS (SELECT * FROM (SELECT DISTINCT op, ns FROM requests) CROSS JOIN b) SELECT e.op, e.ns, CAST(e.le_ns AS BIGINT) AS le_ns, CAST(sum(coalesce(o.n, 0)) OVER (PARTITION BY e.op, e.ns ORDER BY e.le_ns NULLS LAST) AS BIGINT) AS count FROM e LEFT JOIN o ON e.op = o.op AND e.ns = o.ns AND e.le_ns IS NOT DISTINCT FROM o.le_ns",
    "run_rates": _R + _RUNS,
    "measured_window": _R + ", m AS (SELECT *, ts_us % 86400000000 AS d FROM requests), k AS (SELECT * FROM m WHERE d >= 3600000000 AND NOT (error IS NOT NULL AND d * 1000 + latency_ns >= 86400000000000)) " + _RATES.format(by="op", s=RUN_SECONDS - 3600, t="k"),
    "median_run": _R + f", x AS ({_RUNS}), y AS (SELECT *, row_number() OVER (ORDER BY ops_per_sec, run) - 1 AS i, count(*) OVER () AS n, min(ops_per_sec) OVER () AS ops_per_sec_min, max(ops_per_sec) OVER () AS ops_per_sec_max FROM x) SELECT * EXCLUDE (i, n), CASE WHEN ops_per_sec > 0 THEN (ops_per_sec_max - ops_per_sec_min) / ops_per_sec ELSE 0.0 END AS relative_range FROM y WHERE i = n // 2",
    "interp_median": _R + f", x AS ({_RUNS}), m AS (SELECT quantile_cont(operations, 0.5) FILTER (run % 2 = 0) AS cold, quantile_cont(operations, 0.5) FILTER (run % 2 = 1) AS warm, min(operations) AS least, max(operations) AS most FROM x) SELECT *, coalesce((cold - warm) / nullif(cold, 0), 0.0) AS reduction, coalesce(cold / nullif(warm, 0), 0.0) AS speedup FROM m",
    "request_counts": _R + "SELECT op, ns, status, count(*) AS requests FROM requests GROUP BY ALL",
    "in_flight": _R + ", s AS (SELECT op, start_ns AS t, 1 AS d FROM requests UNION ALL SELECT op, start_ns + latency_ns * 10000, -1 FROM requests), g AS (SELECT op, t, sum(d) AS d FROM s GROUP BY ALL), l AS (SELECT op, sum(d) OVER (PARTITION BY op ORDER BY t) AS level FROM g) SELECT op, CAST(max(level) AS BIGINT) AS peak FROM l GROUP BY op",
    "hop_counts": _R + "SELECT CASE WHEN hop = '' THEN 'client' ELSE hop END AS hop, count(*) AS requests FROM requests GROUP BY 1",
    "error_classes": _R + "SELECT CASE WHEN lower(error) LIKE '%connection refused%' OR lower(error) LIKE '%no such host%' OR lower(error) LIKE '%connection reset%' THEN 'conn_refused' WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%deadline exceeded%' THEN 'timeout' ELSE 'none' END AS class, count(*) AS errors FROM requests WHERE error IS NOT NULL GROUP BY 1",
    "log_levels": _R + "SELECT CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 AND status <> 404 THEN 'warn' WHEN status = 404 THEN 'debug' ELSE 'info' END AS level, count(*) AS requests FROM requests GROUP BY 1",
    "error_samples": _R + "SELECT error, count(*) AS n, min(start_ns) AS first_ns FROM requests WHERE error IS NOT NULL GROUP BY error ORDER BY first_ns, error LIMIT 32",
    "retries": _R + "SELECT status, status >= 500 OR status = 429 AS retryable, count(*) AS requests FROM requests GROUP BY ALL",
    "peak_rss": _R + "SELECT node, ts_ns, rss_bytes, goroutines FROM (SELECT hop AS node, start_ns AS ts_ns, bytes * 1024 AS rss_bytes, seq AS goroutines, row_number() OVER (PARTITION BY hop ORDER BY bytes DESC, start_ns) AS i FROM requests) WHERE i = 1",
    "props_metric_parse": "SELECT event_id, 'store_k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS metric_value, CAST(json_extract(props, '$.k') AS BIGINT) AS as_long FROM events",
    "http_statuses": f"""SELECT error, already_stored, CASE WHEN error IS NULL THEN 200 WHEN error IN ('not_found', 'bad_key', 'bad_namespace') THEN 404 WHEN error = 'canceled' THEN 499 ELSE 503 END AS get_status,
CASE WHEN error IS NULL THEN CASE WHEN already_stored THEN 200 ELSE 201 END WHEN error = 'too_large' THEN 413 WHEN error = 'over_quota' THEN 507 WHEN error IN ('digest_mismatch', 'short_write', 'bad_key', 'bad_namespace', 'upload_interrupted') THEN 400 WHEN error IN ('closed', 'insufficient_replicas') THEN 503 WHEN error IN ('canceled', 'deadline_exceeded') THEN 499 ELSE 500 END AS put_status,
coalesce(error = 'over_quota', false) AS declined FROM (VALUES (NULL), {', '.join(f'({e})' for e in _ERRORS)}) e(error) CROSS JOIN (VALUES (true), (false)) a(already_stored)""",
    "op_names": "SELECT * FROM (VALUES ('GET', 'get'), ('HEAD', 'head'), ('PUT', 'put'), ('POST', 'put'), ('DELETE', 'other'), ('get', 'other')) t(method, op)",
    "store_counters": _R + """, n AS (SELECT *, ['node-a', 'node-b', 'node-c'][CAST('0x' || substr(sha256(CAST(seq AS VARCHAR)), 1, 6) AS BIGINT) % 3 + 1] AS node FROM requests),
w AS (SELECT node, count(*) FILTER (op = 'put' AND error IS NULL) AS puts_total, count(*) FILTER (op = 'put' AND error IS NOT NULL) AS puts_rejected_total, count(*) FILTER (op <> 'put' AND error IS NULL AND status = 200) AS hits_total, count(*) FILTER (op <> 'put' AND error IS NULL AND status = 404) AS misses_total,
CAST(coalesce(sum(bytes) FILTER (op = 'put' AND error IS NULL), 0) AS BIGINT) AS bytes_in_total, CAST(coalesce(sum(bytes) FILTER (op <> 'put' AND error IS NULL AND status = 200), 0) AS BIGINT) AS bytes_out_total FROM n GROUP BY node)
SELECT node, metric, counter FROM w UNPIVOT (counter FOR metric IN (puts_total, puts_rejected_total, hits_total, misses_total, bytes_in_total, bytes_out_total))""",
    "access_log_fields": _R + "SELECT seq, CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 AND status <> 404 THEN 'warn' WHEN status = 404 THEN 'debug' ELSE 'info' END AS level, op, status, floor(latency_ns / 1000) / 1000 AS duration_ms, CASE WHEN hop = '' THEN '' ELSE 'peer' END AS forwarded_by FROM requests",
}
