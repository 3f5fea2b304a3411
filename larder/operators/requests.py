"""Latency, throughput and error reports from request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.text import milliseconds, rate

#: Upper bounds of the latency histogram in nanoseconds, from 100 microseconds to 10 seconds.
BUCKETS_NS = (100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000, 1_000_000_000, 2_500_000_000, 5_000_000_000, 10_000_000_000)
PERCENTILES = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99, "p999_ms": 0.999}
ERROR_SAMPLES = 32


#: Low bits of a latency that the coarse histogram leaves out: buckets of some 66 microseconds.
FINE_BITS = 16


def percentiles(rows: DataFrame, value: str, ranks: dict[str, float], *by: str) -> DataFrame:
    """by, count, total, min, max and the nearest-rank percentiles of a non-negative long, per group.

    Exact, from two levels of histograms: counts by the high bits show in which bucket each rank falls, and only those buckets are
    counted by value. A window sees a group's buckets, or the 2 ** FINE_BITS values of one bucket, and never a group's rows. Nulls in `value` don't count.
    """
    rows = rows.select(*by, F.col(value).alias("_v")).where("_v IS NOT NULL")
    coarse = rows.groupBy(*by, F.shiftright("_v", FINE_BITS).alias("_hi")).agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    every = W.partitionBy(*by)
    upto = every.orderBy("_hi").rowsBetween(W.unboundedPreceding, W.currentRow)
    coarse = coarse.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(every)})
    wanted = [F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.least(F.ceil(F.lit(p) * F.col("_all")), F.col("_all"))).alias("rank")) for n, p in ranks.items()]
    falls = coarse.select(*by, "_hi", "_upto", "_n", F.inline(F.array(*wanted))).where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
    falls = falls.select(*by, "_hi", "name", (F.col("rank") - (F.col("_upto") - F.col("_n"))).alias("rank"))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    chosen = falls.select(*by, "_hi").distinct()
    inside = rows.withColumn("_hi", F.shiftright("_v", FINE_BITS)).alias("r").join(chosen.alias("c"), same("r", "c", [*by, "_hi"]), "left_semi")
    fine = inside.groupBy(*by, "_hi", "_v").agg(F.count("*").alias("_n"))
    fine = fine.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by, "_hi").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    hit = fine.alias("f").join(falls.alias("p"), [*same("f", "p", [*by, "_hi"]), (F.col("rank") <= F.col("f._upto")) & (F.col("rank") > F.col("f._upto") - F.col("f._n"))])
    found = hit.groupBy(*[F.col(f"f.{c}").alias(c) for c in by]).agg(*[F.max(F.when(F.col("name") == n, F.col("f._v"))).alias(n) for n in ranks])
    sums = coarse.groupBy(*by).agg(F.sum("_n").alias("count"), F.sum("_sum").alias("total"), F.min("_min").alias("min"), F.max("_max").alias("max"))
    if not by:
        return sums.crossJoin(found)
    joined = sums.alias("s").join(found.alias("x"), same("s", "x", by))
    return joined.select(*[F.col(f"s.{c}").alias(c) for c in by], "count", "total", "min", "max", *ranks)


def latency_summary(requests: DataFrame, *by: str) -> DataFrame:
    """Count, extremes, mean (of whole nanoseconds) and nearest-rank percentiles of latency_ns in milliseconds, per group; all zero for an empty table when not grouped."""
    out = percentiles(requests, "latency_ns", PERCENTILES, *by)
    mean = F.expr("total div nullif(count, 0)")
    ms = lambda c: F.coalesce(milliseconds(c), F.lit(0.0))
    return out.select(*by, F.coalesce("count", F.lit(0)).cast("long").alias("count"), ms(F.col("min")).alias("min_ms"), ms(mean).alias("mean_ms"), *[ms(F.col(n)).alias(n) for n in PERCENTILES], ms(F.col("max")).alias("max_ms"))


def latency_histogram(requests: DataFrame, *by: str) -> DataFrame:
    """Cumulative counts per upper bound (`le_ns`, null for infinity) and group. Each request is counted in its own bucket first; the sums run over 17 buckets."""
    le = F.lit(None).cast("long")
    for b in reversed(BUCKETS_NS):
        le = F.when(F.col("latency_ns") <= b, F.lit(b)).otherwise(le)
    own = requests.groupBy(*by, le.alias("le_ns")).agg(F.count("*").alias("n"))
    bounds = requests.sparkSession.createDataFrame([(b,) for b in BUCKETS_NS] + [(None,)], "le_ns long")
    every = own.select(*by).distinct().crossJoin(F.broadcast(bounds)) if by else bounds
    joined = every.alias("e").join(own.alias("o"), (F.col("e.le_ns").eqNullSafe(F.col("o.le_ns"))) & F.expr(" AND ".join([f"e.{c} <=> o.{c}" for c in by]) or "true"), "left")
    run = W.partitionBy(*[F.col(f"e.{c}") for c in by]).orderBy(F.col("e.le_ns").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(*[F.col(f"e.{c}").alias(c) for c in by], F.col("e.le_ns").alias("le_ns"), F.sum(F.coalesce("o.n", F.lit(0))).over(run).cast("long").alias("count"))


def run_rates(requests: DataFrame, seconds: Column, *by: str) -> DataFrame:
    """Operations (errors are among them), errors, misses, bytes of what was served, and rates, per group."""
    bad = F.col("error").isNotNull()
    miss = ~bad & (F.col("status") == 404)
    sums = requests.groupBy(*by).agg(F.count("*").alias("operations"), F.count_if(bad).alias("errors"), F.count_if(miss).alias("misses"), F.coalesce(F.sum(F.when(~bad & ~miss, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), F.first(seconds).alias("_s"))
    return sums.select(*by, "operations", "errors", "misses", "bytes", rate(F.col("operations"), F.col("_s")).alias("ops_per_sec"), (rate(F.col("bytes"), F.col("_s")) / (1 << 20)).alias("mib_per_sec"), rate(F.col("errors"), F.col("operations")).alias("error_rate"))


def median_run(runs: DataFrame, run: str = "run", *by: str) -> DataFrame:
    """The whole run with the middle (of an even number, the upper middle) throughput, and the spread over all, per group. One row per run comes in, so the window is small."""
    order = W.partitionBy(*by).orderBy("ops_per_sec", run)
    every = W.partitionBy(*by)
    rows = runs.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(every), "ops_per_sec_min": F.min("ops_per_sec").over(every), "ops_per_sec_max": F.max("ops_per_sec").over(every)})
    middle = rows.where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_i", "_n")
    return middle.withColumn("relative_range", F.when(F.col("ops_per_sec") > 0, (F.col("ops_per_sec_max") - F.col("ops_per_sec_min")) / F.col("ops_per_sec")).otherwise(0.0))


def reduction(cold: Column, warm: Column) -> tuple[Column, Column]:
    """(share saved, speedup), 0 where the divisor is 0."""
    return rate(cold - warm, cold), rate(cold, warm)


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("op", "ns", "status").agg(F.count("*").alias("requests"))


def hop_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.when(F.coalesce("hop", F.lit("")) == "", "client").otherwise(F.col("hop")).alias("hop")).agg(F.count("*").alias("requests"))


def in_flight_peak(requests: DataFrame, *by: str) -> DataFrame:
    """The highest number of requests being served at once (started at start_ns, for latency_ns; at one instant, ends come before starts), per group.

    Running sums are taken within a second, on top of what the seconds before leave open in their hour and the hours before that, so
    no window holds more than one second's requests, one hour's seconds or a group's hours.
    """
    hour, second = 3_600_000_000_000, 1_000_000_000
    begun = requests.select(*by, F.col("start_ns").alias("at"), F.lit(1).alias("d"))
    ended = requests.select(*by, (F.col("start_ns") + F.col("latency_ns")).alias("at"), F.lit(-1).alias("d"))
    steps = begun.unionByName(ended).groupBy(*by, "at").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("starts")).withColumns({"hour": F.expr(f"at div {hour}"), "second": F.expr(f"at div {second}")})
    seconds = steps.groupBy(*by, "hour", "second").agg(F.sum("d").alias("net"))
    hours = seconds.groupBy(*by, "hour").agg(F.sum("net").alias("net"))
    before = lambda w: F.coalesce(F.sum("net").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = hours.select(*by, "hour", before(W.partitionBy(*by).orderBy("hour")).alias("earlier"))
    within = seconds.select(*by, "hour", "second", before(W.partitionBy(*by, "hour").orderBy("second")).alias("within"))
    open_ = within.join(earlier, [*by, "hour"]).select(*by, "second", (F.col("earlier") + F.col("within")).alias("open"))
    run = W.partitionBy(*by, "second").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    levels = steps.join(open_, [*by, "second"]).withColumn("level", F.col("open") + F.sum("d").over(run))
    return levels.groupBy(*by).agg(F.max("level").cast("long").alias("peak"))


def error_samples(requests: DataFrame, limit: int = ERROR_SAMPLES) -> DataFrame:
    """Counts of error texts, of the first `limit` distinct ones by when each was first seen."""
    return requests.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"), F.min("start_ns").alias("first_ns")).orderBy("first_ns", "error").limit(limit)


def peak_rss(samples: DataFrame) -> DataFrame:
    """Per node, the whole sample with the most resident memory (the first of equals)."""
    best = F.max_by(F.struct("ts_ns", "rss_bytes", "goroutines"), F.struct("rss_bytes", -F.col("ts_ns")))
    return samples.groupBy("node").agg(best.alias("s")).select("node", "s.*")


def traffic(requests: DataFrame, seconds: float) -> DataFrame:
    """Writes and reads with their errors; a write refused for want of replicas (503) is no error."""
    write, bad = F.col("op") == "put", F.col("error").isNotNull()
    refused = write & (F.col("status") == 503)
    out = requests.agg(
        F.count_if(write).alias("writes"), F.count_if(write & ~bad).alias("writes_ok"), F.count_if(refused).alias("writes_refused"), F.count_if(write & bad & ~refused).alias("write_errors"),
        F.count_if(~write).alias("reads"), F.count_if(~write & ~bad & (F.col("status") == 200)).alias("read_hits"), F.count_if(~write & ~bad & (F.col("status") == 404)).alias("read_misses"), F.count_if(~write & bad).alias("read_errors"),
        F.count_if(bad & (F.col("status") >= 500)).alias("server_errors"),
    )
    ops = F.col("writes") + F.col("reads")
    return out.withColumns({"ops_per_second": rate(ops, F.lit(seconds)), "error_rate": rate(F.col("write_errors") + F.col("read_errors"), ops)})
