"""Counters of a node's subsystems, the metrics derived from them, and reports put together from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.text import rate
from larder.operators import requests

#: The counters of each subsystem.
COUNTERS = {
    "store": ("puts_ok", "puts_rejected", "puts_already_stored", "gets", "get_misses", "deletes", "bytes_in", "bytes_out", "objects_stored", "bytes_stored", "verify_failures"),
    "coordinator": ("local_hits", "peer_hits", "misses", "read_fallbacks", "replica_writes", "replica_failures", "insufficient_acks", "forwarded_puts", "coordinated_puts", "repair_declined"),
    "index": ("inserts", "deletes", "touches_queued", "touch_flushes", "touches_written", "touches_dropped"),
    "evictor": ("sweeps", "evicted", "bytes_reclaimed", "failures", "overshoot"),
    "repair": ("audit_runs", "objects_audited", "enqueued", "dropped_full_queue", "repaired", "already_present", "failed", "bytes_repaired", "not_ours", "declined_over_quota", "queue_depth", "queue_capacity"),
    "chaos": ("writes", "write_ok", "write_refused", "write_error", "reads", "read_hits", "read_misses", "read_errors", "reads_verified", "corrupted_reads", "bytes_written", "bytes_read", "conn_refused", "timeouts", "server_errors"),
}
#: Derived metrics by subsystem and counter; a label where one name has several series.
METRICS = (
    ("bytes_in_total", "store.bytes_in", None), ("bytes_out_total", "store.bytes_out", None), ("puts_total", "store.puts_ok", None), ("puts_rejected_total", "store.puts_rejected", None),
    ("puts_already_stored_total", "store.puts_already_stored", None), ("verify_failures_total", "store.verify_failures", None),
    ("hits_total", "coordinator.local_hits", "local"), ("hits_total", "coordinator.peer_hits", "peer"), ("misses_total", "coordinator.misses", None), ("read_fallbacks_total", "coordinator.read_fallbacks", None),
    ("replication_failures_total", "coordinator.replica_failures", None), ("insufficient_replicas_total", "coordinator.insufficient_acks", None), ("proxied_puts_total", "coordinator.forwarded_puts", None),
    ("repair_declined_over_quota_total", "coordinator.repair_declined", None), ("evictions_total", "evictor.evicted", None), ("evicted_bytes_total", "evictor.bytes_reclaimed", None),
    ("eviction_sweeps_total", "evictor.sweeps", None), ("eviction_failures_total", "evictor.failures", None), ("index_touches_written_total", "index.touches_written", None), ("index_touches_dropped_total", "index.touches_dropped", None),
    ("repair_queue_depth", "repair.queue_depth", None), ("repair_queue_capacity", "repair.queue_capacity", None), ("repair_completed_total", "repair.repaired", None), ("repair_bytes_total", "repair.bytes_repaired", None),
    ("repair_failed_total", "repair.failed", None), ("repair_audited_total", "repair.objects_audited", None), ("repair_dropped_full_queue_total", "repair.dropped_full_queue", None),
)


def counters(events: DataFrame) -> DataFrame:
    """(node, subsystem, counter, n): sums of increments (node, subsystem, counter, by), zero for a known counter of a node that had none."""
    known = events.sparkSession.createDataFrame([(s, c) for s, cs in COUNTERS.items() for c in cs], "subsystem string, counter string")
    sums = events.groupBy("node", "subsystem", "counter").agg(F.sum("by").alias("n"))
    every = events.select("node").distinct().crossJoin(F.broadcast(known))
    return every.join(sums, ["node", "subsystem", "counter"], "left").select("node", "subsystem", "counter", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def derived_metrics(counted: DataFrame, usage: DataFrame) -> DataFrame:
    """(node, name, labels, value) of every series, from counters and usage (node, objects, bytes, quota_bytes, high_water_bytes, low_water_bytes).

    replication_attempts_total adds replica writes received to sends that failed, which is what the name has always stood for.
    """
    spark = counted.sparkSession
    named = spark.createDataFrame([(*path.split("."), name, source) for name, path, source in METRICS], "subsystem string, counter string, name string, source string")
    label = F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), "source")).otherwise(F.create_map().cast("map<string,string>"))
    plain = counted.join(F.broadcast(named), ["subsystem", "counter"]).select("node", "name", label.alias("labels"), F.col("n").cast("double").alias("value"))
    none = F.create_map().cast("map<string,string>").alias("labels")
    tries = counted.where("subsystem = 'coordinator' AND counter IN ('replica_writes', 'replica_failures')").groupBy("node").agg(F.sum("n").cast("double").alias("value"))
    tries = tries.select("node", F.lit("replication_attempts_total").alias("name"), none, "value")
    gauges = {"stored_objects": "objects", "stored_bytes": "bytes", "quota_bytes": "quota_bytes", "high_water_bytes": "high_water_bytes", "low_water_bytes": "low_water_bytes"}
    wide = usage.select("node", *[F.col(c).cast("double").alias(n) for n, c in gauges.items()])
    held = wide.unpivot(["node"], list(gauges), "name", "value").select("node", "name", none, "value")
    return plain.unionByName(tries).unionByName(held)


def differences(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """What counters (by, counter, n) rose by from one reading to the next; a counter that was not there before counts from 0, and one that a restart reset counts from 0 again."""
    old = before.select(*by, "counter", F.col("n").alias("_was"))
    both = after.join(old, [*by, "counter"], "left")
    was = F.coalesce("_was", F.lit(0))
    return both.select(*by, "counter", F.when(F.col("n") < was, F.col("n")).otherwise(F.col("n") - was).alias("delta"))


def chaos_report(traffic: DataFrame, correctness: DataFrame, convergence: DataFrame, final: DataFrame, eviction: DataFrame, faults_enabled: bool, n_faults: int) -> DataFrame:
    """One nested row of parts that are one row each, with the verdict."""
    parts = {"traffic": traffic, "correctness": correctness, "convergence": convergence, "final_verification": final, "eviction": eviction}
    out = None
    for name, part in parts.items():
        one = part.limit(1).select(F.struct(*part.columns).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    verdict = rules.verdict(F.col("correctness.corrupted_reads"), F.col("final_verification.corrupted"), F.col("final_verification.missing"), F.col("eviction.observed"), F.lit(True), F.col("convergence.converged"), F.lit(faults_enabled), F.lit(n_faults), F.col("traffic.error_rate"))
    return out.withColumn("verdict", verdict)


#: What a bench report keeps of the middle run of each scenario.
POINT = ("run", "operations", "errors", "misses", "bytes", "ops_per_sec", "ops_per_sec_min", "ops_per_sec_max", "mib_per_sec", "p50_ms", "p95_ms", "p99_ms", "p999_ms")


def bench_report(runs: DataFrame, scenario: str, setup: dict[str, str | int | float | bool]) -> DataFrame:
    """One nested row: the setup, and each scenario's middle run with the spread over its runs. runs: one row for each scenario and run."""
    points = requests.median_run(runs, "run", scenario).join(runs.groupBy(scenario).agg(F.count("*").alias("runs")), scenario)
    point = F.struct(F.col(scenario).alias("name"), "runs", *POINT)
    said = F.struct(*[F.lit(v).alias(k) for k, v in setup.items()])
    return points.agg(F.array_sort(F.collect_list(point)).alias("scenarios")).select(F.lit("benchmark").alias("kind"), said.alias("setup"), "scenarios")


def bench_markdown(report: DataFrame, shown: tuple[str, ...] = POINT) -> DataFrame:
    """(markdown): a bench report (one row) as text, its setup as a table and each scenario's as one of its own, in the order of names."""
    lines = [F.concat(F.lit(f"| {k} | "), F.coalesce(F.col(f"setup.{k}").cast("string"), F.lit("")), F.lit(" |")) for k in report.schema["setup"].dataType.names]
    setup = F.concat(F.lit("## Setup\n\n| | |\n|---|---|\n"), F.concat_ws("\n", *lines))
    head = F.lit("| runs | " + " | ".join(shown) + " |\n|" + "---:|" * (1 + len(shown)) + "\n")
    cells = lambda s: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(s[c].cast("string"), F.lit("")) for c in ("runs", *shown)]), F.lit(" |"))
    tables = F.transform("scenarios", lambda s: F.concat(F.lit("### `"), s["name"], F.lit("`\n\n"), head, cells(s)))
    return report.select(F.concat_ws("\n\n", F.lit("# Benchmarks"), setup, F.lit("## Results"), F.array_join(tables, "\n\n")).alias("markdown"))


def choose(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The rows of the named scenarios; raises if no name is known among the rows."""
    chosen = rows.where(F.col(column).isin(names))
    if chosen.limit(1).count() == 0:
        raise ValueError(f"no scenario matches {names}")
    return chosen


def hit_rate(counted: DataFrame) -> DataFrame:
    """Share of reads served, per node."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0))
    sums = counted.where("subsystem = 'coordinator'").groupBy("node").agg((n("local_hits") + n("peer_hits")).alias("hits"), n("misses").alias("misses"))
    return sums.withColumn("hit_rate", rate(F.col("hits"), F.col("hits") + F.col("misses")))
