"""Counters, derived metrics, audit passes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import placement as P
from larder.operators import repair as R
from larder.operators import reports
from larder.plans import checking, serving
from larder.plans.base import NODES, SQL_PLACED, SQL_REQUESTS, cluster, contents, holdings, requests
from larder.sources import generators

CURSOR, CAPACITY, PAGE, BUDGET = ("cas", "4"), 40, 16, 100


#: What each request adds to, by conditions that Spark and DuckDB read alike; and by how much.
_PUT, _GET = "op = 'put' AND error IS NULL", "op <> 'put' AND error IS NULL AND status <> 404"
INCREMENTS = (
    ("store.puts_ok", _PUT, "1"), ("store.puts_rejected", "op = 'put' AND error IS NOT NULL AND status <> 503", "1"), ("store.gets", _GET, "1"), ("store.get_misses", "op <> 'put' AND error IS NULL AND status = 404", "1"),
    ("store.bytes_in", _PUT, "bytes"), ("store.bytes_out", _GET, "bytes"), ("store.objects_stored", _PUT, "1"), ("store.bytes_stored", _PUT, "bytes"),
    ("coordinator.local_hits", _GET + " AND hop <> 'read'", "1"), ("coordinator.peer_hits", _GET + " AND hop = 'read'", "1"), ("coordinator.misses", "op <> 'put' AND error IS NULL AND status = 404", "1"),
    ("coordinator.coordinated_puts", _PUT + " AND hop = ''", "1"), ("coordinator.forwarded_puts", _PUT + " AND hop = 'coordinator'", "1"), ("coordinator.replica_writes", _PUT + " AND hop = 'replica'", "1"),
    ("coordinator.insufficient_acks", "op = 'put' AND status = 503", "1"), ("coordinator.replica_failures", "op <> 'put' AND error IS NOT NULL", "1"),
    ("index.inserts", _PUT, "1"), ("index.touches_queued", _GET, "1"), ("index.touches_written", _GET + " AND ns = 'cas'", "1"),
    ("chaos.writes", "op = 'put'", "1"), ("chaos.write_ok", _PUT, "1"), ("chaos.write_refused", "op = 'put' AND status = 503", "1"), ("chaos.write_error", "op = 'put' AND error IS NOT NULL AND status <> 503", "1"),
    ("chaos.reads", "op <> 'put'", "1"), ("chaos.read_hits", "op <> 'put' AND status = 200", "1"), ("chaos.read_misses", "op <> 'put' AND status = 404", "1"), ("chaos.read_errors", "op <> 'put' AND error IS NOT NULL", "1"),
    ("chaos.bytes_written", _PUT, "bytes"), ("chaos.bytes_read", _GET, "bytes"), ("chaos.conn_refused", "error LIKE '%connection refused%'", "1"), ("chaos.timeouts", "error LIKE '%deadline exceeded%'", "1"), ("chaos.server_errors", "error IS NOT NULL AND status >= 500", "1"),
)


def _increments(spark: SparkSession, sf: str) -> DataFrame:
    """Increments of counters on nodes in turn."""
    r = requests(spark, sf).withColumn("node", F.element_at(F.array(*map(F.lit, NODES)), (F.col("seq") % 3 + 1).cast("int")))
    one = lambda path, when, by: F.struct(F.lit(path.split(".")[0]).alias("subsystem"), F.lit(path.split(".")[1]).alias("counter"), F.expr(f"CASE WHEN {when} THEN {by} END").cast("long").alias("by"))
    return r.select("seq", "node", F.inline(F.filter(F.array(*[one(*x) for x in INCREMENTS]), lambda x: x["by"].isNotNull())))


def subsystem_counters(spark: SparkSession, sf: str) -> DataFrame:
    return reports.counters(_increments(spark, sf))


def hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.hit_rate(subsystem_counters(spark, sf))


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    per = holdings(spark, sf).groupBy("node").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    usage = per.withColumns({"quota_bytes": F.lit(1_000_000), "high_water_bytes": F.lit(900_000), "low_water_bytes": F.lit(700_000)})
    return reports.derived_metrics(subsystem_counters(spark, sf), usage)


def derived_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metric_series(spark, sf).select("node", "name", F.coalesce(F.try_element_at("labels", F.lit("source")), F.lit("")).alias("source"), "value")


def build_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """What each counter rose by from the first half of the requests to all of them."""
    every = _increments(spark, sf)
    middle = requests(spark, sf).agg(F.max("seq")).first()[0] // 2
    return reports.differences(reports.counters(every.where(F.col("seq") <= middle)), reports.counters(every), "node", "subsystem")


def audit_pass(spark: SparkSession, sf: str) -> DataFrame:
    objects = contents(spark, sf).withColumn("ns", F.lit("cas"))
    return R.audit_pass(objects, P.holds(contents(spark, sf).select("key"), cluster(spark), "node-a", 2), CURSOR, CAPACITY, PAGE, BUDGET)


def chaos_report(spark: SparkSession, sf: str) -> DataFrame:
    corrupted = checking.ledger_verify(spark, sf).agg(F.count("*").alias("corrupted_reads"))
    r = reports.chaos_report(checking.chaos_traffic(spark, sf), corrupted, serving.replica_convergence(spark, sf), checking.final_verify(spark, sf), checking.stats_eviction_totals(spark, sf), True, 3)
    return r.select("traffic.writes", "traffic.error_rate", "correctness.corrupted_reads", F.col("convergence.under").alias("under"), "final_verification.checked", "eviction.objects_evicted", "verdict")


def fault_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return generators.fault_schedule(spark, list(NODES), 601, 60, 25)


_NAMES = (subsystem_counters, hit_rates, derived_metrics, build_deltas, audit_pass, chaos_report, fault_schedule)
QUERIES = {f.__name__: f for f in _NAMES}

_INC = f"""{SQL_REQUESTS}, x AS (SELECT *, ['node-a', 'node-b', 'node-c'][seq % 3 + 1] AS node FROM requests),
i AS ({" UNION ALL ".join(f"SELECT seq, node, '{path}' AS c, CAST({by} AS BIGINT) AS n FROM x WHERE {when}" for path, when, by in INCREMENTS)}),
known AS (SELECT unnest([{", ".join(f"'{s}.{c}'" for s, cs in reports.COUNTERS.items() for c in cs)}]) AS c)"""


def _counted(where: str = "true", name: str = "counted") -> str:
    return f"{name} AS (SELECT d.node, split_part(k.c, '.', 1) AS subsystem, split_part(k.c, '.', 2) AS counter, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT node FROM i) d CROSS JOIN known k LEFT JOIN (SELECT node, c, sum(n) AS n FROM i WHERE {where} GROUP BY node, c) s ON s.node = d.node AND s.c = k.c)"


_SERIES = ", ".join(f"('{path}', '{name}', '{source or ''}')" for name, path, source in reports.METRICS)
_PARTS = {n: o for m in (checking, serving) for n, o in m.ORACLES.items()}

ORACLES = {
    "subsystem_counters": f"WITH {_INC}, {_counted()} SELECT * FROM counted",
    "hit_rates": f"WITH {_INC}, {_counted()}, h AS (SELECT node, CAST(sum(n) FILTER (counter IN ('local_hits', 'peer_hits')) AS BIGINT) AS hits, CAST(sum(n) FILTER (counter = 'misses') AS BIGINT) AS misses FROM counted WHERE subsystem = 'coordinator' GROUP BY node) SELECT *, coalesce(hits / nullif(CAST(hits + misses AS DOUBLE), 0), 0.0) AS hit_rate FROM h",
    "derived_metrics": SQL_PLACED + f""", {_INC}, {_counted()}, names(path, name, source) AS (VALUES {_SERIES}), u AS (SELECT node, count(*) AS objects, sum(size) AS bytes FROM holdings GROUP BY node)
SELECT node, name, source, CAST(n AS DOUBLE) AS value FROM counted JOIN names ON path = subsystem || '.' || counter
UNION ALL SELECT node, 'replication_attempts_total', '', CAST(sum(n) AS DOUBLE) FROM counted WHERE counter IN ('replica_writes', 'replica_failures') GROUP BY node
UNION ALL SELECT node, g.name, '', CAST(CASE g.name WHEN 'stored_objects' THEN objects WHEN 'stored_bytes' THEN bytes WHEN 'quota_bytes' THEN 1000000 WHEN 'high_water_bytes' THEN 900000 ELSE 700000 END AS DOUBLE) FROM u CROSS JOIN (VALUES ('stored_objects'), ('stored_bytes'), ('quota_bytes'), ('high_water_bytes'), ('low_water_bytes')) g(name)""",
    "build_deltas": f"WITH {_INC}, {_counted()}, {_counted('seq <= (SELECT max(seq) // 2 FROM x)', 'half')} SELECT c.node, c.subsystem, c.counter, c.n - h.n AS delta FROM counted c JOIN half h ON c.node = h.node AND c.subsystem = h.subsystem AND c.counter = h.counter",
    "audit_pass": SQL_PLACED
    + f""", e AS (SELECT 'cas' AS ns, c.key, c.size, o.key IS NOT NULL AS ours FROM contents c LEFT JOIN (SELECT key FROM ranked WHERE rank <= 2 AND name = 'node-a') o ON c.key = o.key WHERE c.key > '{CURSOR[1]}' ORDER BY c.key LIMIT {-(-BUDGET // PAGE) * PAGE}),
q AS (SELECT *, count(*) FILTER (ours) OVER (ORDER BY key) AS q FROM e) SELECT ns, key, size, CASE WHEN NOT ours THEN 'not_ours' WHEN q <= {CAPACITY} THEN 'queued' ELSE 'refused' END AS state FROM q WHERE q <= {CAPACITY} OR (ours AND q = {CAPACITY} + 1)""",
    "chaos_report": f"""SELECT t.writes, t.error_rate, l.corrupted_reads, c.under, f.checked, e.objects_evicted, 'FAIL: corrupted data was served' AS verdict
FROM ({_PARTS['chaos_traffic']}) t, (SELECT count(*) AS corrupted_reads FROM ({_PARTS['ledger_verify']})) l, ({_PARTS['replica_convergence']}) c, ({_PARTS['final_verify']}) f, ({_PARTS['stats_eviction_totals']}) e""",
    "fault_schedule": "SELECT i AS fault, ['node-a', 'node-b', 'node-c'][i % 3 + 1] AS node, (i + 1) * 60 AS from_s, least((i + 1) * 60 + 25, 601) AS to_s FROM range(10) t(i) WHERE (i + 1) * 60 < 601",
}
