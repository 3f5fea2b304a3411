"""Index, eviction and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import rules
from larder.operators import eviction as E
from larder.operators import index as I
from larder.operators import reconcile as R
from larder.plans.base import SQL_ACCESSES, SQL_OBJECTS, SQL_TOUCHED, accesses, objects

#: The quota of the eviction queries: a fixed number of bytes for each order, so that it is passed at every scale.
BYTES_EACH, HIGH, LOW = 9_000_000, 0.9, 0.7


def touched(spark: SparkSession, sf: str) -> DataFrame:
    return I.flush_touches(objects(spark, sf), accesses(spark, sf))


def writes(spark: SparkSession, sf: str) -> DataFrame:
    """Later writes: every tenth order again, larger, and as many new ones."""
    old = objects(spark, sf)
    digit = F.conv(F.substring("key", 1, 2), 16, 10).cast("int")
    again = old.where(digit < 26).select("ns", "key", (F.col("size") + 7).alias("size"), (F.col("created_ns") + 1_000).alias("at_ns"))
    new = old.where(digit >= 230).select("ns", F.reverse("key").alias("key"), "size", F.col("created_ns").alias("at_ns"))
    return again.unionByName(new)


def index_totals(spark: SparkSession, sf: str) -> DataFrame:
    return I.totals(objects(spark, sf))


def index_totals_empty(spark: SparkSession, sf: str) -> DataFrame:
    return I.totals(objects(spark, sf).where("size < 0"))


def index_point_get(spark: SparkSession, sf: str) -> DataFrame:
    from hashlib import sha256

    return I.get(touched(spark, sf), "cas", sha256(b"object-1").hexdigest())


def index_scan(spark: SparkSession, sf: str) -> DataFrame:
    return objects(spark, sf)


def coldest_n(spark: SparkSession, sf: str) -> DataFrame:
    return I.coldest(touched(spark, sf), 100)


def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return I.page_after(objects(spark, sf), "ac", "f" * 64, 512).select("ns", "key", "size")


def index_upsert_fold(spark: SparkSession, sf: str) -> DataFrame:
    return I.upsert(objects(spark, sf), writes(spark, sf))


def touch_flush(spark: SparkSession, sf: str) -> DataFrame:
    return touched(spark, sf)


def batch_remove(spark: SparkSession, sf: str) -> DataFrame:
    return I.remove(objects(spark, sf), objects(spark, sf).where("size % 3 = 0"))


def replace_all(spark: SparkSession, sf: str) -> DataFrame:
    return I.replace_all(objects(spark, sf).withColumn("access_count", F.col("size") % 3))


def meta_upsert(spark: SparkSession, sf: str) -> DataFrame:
    meta = spark.createDataFrame([("reconciled_at", "never"), ("version", "1")], I.META)
    changes = spark.createDataFrame([("reconciled_at", "today", 1), ("reconciled_at", "now", 2), ("node", "a", 3)], "key string, value string, seq int")
    return I.set_meta(meta, changes)


def eviction_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_score(touched(spark, sf)).select("ns", "key", "score")


def quota(spark: SparkSession, sf: str) -> int:
    return BYTES_EACH * objects(spark, sf).count()


def eviction_victims(spark: SparkSession, sf: str) -> DataFrame:
    return E.victims(touched(spark, sf), quota(spark, sf), HIGH, LOW)


def eviction_summary(spark: SparkSession, sf: str) -> DataFrame:
    gone = E.victims(touched(spark, sf), quota(spark, sf), HIGH, LOW)
    return gone.agg(F.count("*").alias("evicted"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_reclaimed"))


def eviction_not_needed(spark: SparkSession, sf: str) -> DataFrame:
    """Under a quota ten times as large nothing goes."""
    return E.victims(touched(spark, sf), 100 * quota(spark, sf), HIGH, LOW)


def quota_marks(spark: SparkSession, sf: str) -> DataFrame:
    cases = [(1000, 0.9, 0.8), (4 << 20, 0.9, 0.7), (0, 0.9, 0.7), (-5, 0.9, 0.7), (1000, 0.0, -1.0), (1000, 1.1, 0.5), (1000, 0.9, 0.9), (1000, 0.9, 0.0), (12 << 30, 0.9, 0.7)]
    rows = spark.createDataFrame(cases, "max_bytes long, high double, low double")
    m, h, low = F.col("max_bytes"), F.col("high"), F.col("low")
    return rows.select("max_bytes", "high", "low", rules.water_mark(m, h).alias("high_bytes"), rules.water_mark(m, low).alias("low_bytes"), rules.quota_error(m, h, low).alias("error"))


def over_high_water(spark: SparkSession, sf: str) -> DataFrame:
    return E.usage(objects(spark, sf), quota(spark, sf), HIGH, LOW)


def disk(spark: SparkSession, sf: str) -> DataFrame:
    """What lies on disk: objects but for some, some of other sizes."""
    digit = F.conv(F.substring("key", 3, 2), 16, 10).cast("int")
    return objects(spark, sf).where(digit >= 20).select("ns", "key", (F.col("size") + (digit < 40).cast("long")).alias("size"), (F.col("created_ns") + 5).alias("mod_ns"))


def reconcile_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.reconcile(disk(spark, sf), _indexed(spark, sf)).drop("was_indexed")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    return touched(spark, sf).where("substr(key, 1, 1) <> 'a'")


def reconcile_counters(spark: SparkSession, sf: str) -> DataFrame:
    return R.counters(R.reconcile(disk(spark, sf), _indexed(spark, sf)))


def reconcile_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return I.replace_all(R.survivors(R.reconcile(disk(spark, sf), _indexed(spark, sf))))


def disk_usage(spark: SparkSession, sf: str) -> DataFrame:
    return disk(spark, sf).groupBy("ns").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


_NAMES = (index_totals, index_totals_empty, index_point_get, index_scan, coldest_n, keyset_page, index_upsert_fold, touch_flush, batch_remove, replace_all, meta_upsert, eviction_scores, eviction_victims, eviction_summary, eviction_not_needed, quota_marks, over_high_water, reconcile_rows, reconcile_counters, reconcile_survivors, disk_usage)
QUERIES = {f.__name__: f for f in _NAMES}

_BASE = f"WITH {SQL_OBJECTS}, {SQL_ACCESSES}, {SQL_TOUCHED}"
_TOTALS = "SELECT count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM objects"


def _series() -> str:
    out = repr(1.0 / (2 * E.TERMS - 1))
    for k in range(E.TERMS - 2, -1, -1):
        out = f"(CAST('{1.0 / (2 * k + 1)!r}' AS DOUBLE) + z * {out})" if k < E.TERMS - 2 else f"(CAST('{1.0 / (2 * k + 1)!r}' AS DOUBLE) + z * CAST('{out}' AS DOUBLE))"
    return out


_SCORED = f"""scored AS (SELECT ns, key, size, created_ns, last_access_ns, access_count, last_access_ns - CAST(trunc(CASE WHEN f = 0.5 THEN e - 1 ELSE e + 2 * s * {_series()} * CAST('{E.RECIPROCAL!r}' AS DOUBLE) END * CAST(3600000000000 AS DOUBLE)) AS BIGINT) AS score
  FROM (SELECT *, s * s AS z FROM (SELECT *, (f - 1) / (f + 1) AS s FROM (SELECT *, x / pow(CAST(2 AS DOUBLE), e) AS f FROM (SELECT *, floor(log2(x)) + 1 AS e FROM (SELECT *, 1 + size / CAST(65536 AS DOUBLE) AS x FROM touched))))))"""


def victims_sql(factor: int = 1) -> str:
    quota = f"({factor * BYTES_EACH} * (SELECT count(*) FROM objects))"
    return f"""{_BASE}, {_SCORED}, q AS (SELECT sum(size) AS used, CAST(trunc(CAST({quota} AS DOUBLE) * {HIGH}) AS BIGINT) AS high, CAST(trunc(CAST({quota} AS DOUBLE) * {LOW}) AS BIGINT) AS low FROM touched),
b AS (SELECT *, (row_number() OVER (ORDER BY last_access_ns, ns, key) - 1) // 512 AS batch FROM scored),
r AS (SELECT *, sum(size) OVER o - size AS freed, row_number() OVER o AS "order" FROM b WINDOW o AS (ORDER BY batch, score, ns, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT ns, key, size, last_access_ns, score, "order" FROM r, q WHERE used > high AND freed < used - low) """


_DIGIT = "CAST('0x' || substr(key, {n}, 2) AS INTEGER)"
_DISK = f"disk AS (SELECT ns, key, size + CASE WHEN {_DIGIT.format(n=3)} < 40 THEN 1 ELSE 0 END AS size, created_ns + 5 AS mod_ns FROM objects WHERE {_DIGIT.format(n=3)} >= 20)"
_RECONCILED = f"""{_BASE}, {_DISK}, known AS (SELECT * FROM touched WHERE substr(key, 1, 1) <> 'a'),
rec AS (SELECT coalesce(d.ns, k.ns) AS ns, coalesce(d.key, k.key) AS key, coalesce(d.size, k.size) AS size, coalesce(k.created_ns, d.mod_ns) AS created_ns, coalesce(k.last_access_ns, d.mod_ns) AS last_access_ns, coalesce(k.access_count, 1) AS access_count,
  CASE WHEN d.key IS NULL THEN 'removed_stale' WHEN k.key IS NULL THEN 'added' WHEN d.size <> k.size THEN 'size_corrected' ELSE 'kept' END AS class, k.key IS NOT NULL AS was_indexed FROM disk d FULL OUTER JOIN known k ON d.ns = k.ns AND d.key = k.key) """

ORACLES = {
    "index_totals": f"WITH {SQL_OBJECTS} {_TOTALS}",
    "index_totals_empty": f"WITH {SQL_OBJECTS} {_TOTALS} WHERE size < 0",
    "index_point_get": f"{_BASE} SELECT * FROM touched WHERE ns = 'cas' AND key = sha256('object-1')",
    "index_scan": f"WITH {SQL_OBJECTS} SELECT * FROM objects",
    "coldest_n": f"{_BASE} SELECT * FROM touched ORDER BY last_access_ns, ns, key LIMIT 100",
    "keyset_page": f"WITH {SQL_OBJECTS} SELECT ns, key, size FROM objects WHERE ns > 'ac' OR (ns = 'ac' AND key > repeat('f', 64)) ORDER BY ns, key LIMIT 512",
    "index_upsert_fold": f"""WITH {SQL_OBJECTS}, writes AS (SELECT ns, key, size + 7 AS size, created_ns + 1000 AS at_ns FROM objects WHERE {_DIGIT.format(n=1)} < 26 UNION ALL SELECT ns, reverse(key), size, created_ns FROM objects WHERE {_DIGIT.format(n=1)} >= 230)
SELECT coalesce(o.ns, w.ns) AS ns, coalesce(o.key, w.key) AS key, coalesce(w.size, o.size) AS size, coalesce(o.created_ns, w.at_ns) AS created_ns, coalesce(w.at_ns, o.last_access_ns) AS last_access_ns, coalesce(o.access_count, 1) AS access_count FROM objects o FULL OUTER JOIN writes w ON o.ns = w.ns AND o.key = w.key""",
    "touch_flush": f"{_BASE} SELECT * FROM touched",
    "batch_remove": f"WITH {SQL_OBJECTS} SELECT * FROM objects WHERE size % 3 <> 0",
    "replace_all": f"WITH {SQL_OBJECTS} SELECT ns, key, size, created_ns, last_access_ns, greatest(size % 3, 1) AS access_count FROM objects",
    "meta_upsert": "SELECT * FROM (VALUES ('reconciled_at', 'now'), ('version', '1'), ('node', 'a')) t(key, value)",
    "eviction_scores": f"{_BASE}, {_SCORED} SELECT ns, key, score FROM scored",
    "eviction_victims": victims_sql() + "SELECT * FROM v",
    "eviction_summary": victims_sql() + "SELECT count(*) AS evicted, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_reclaimed FROM v",
    "eviction_not_needed": victims_sql(100) + "SELECT * FROM v",
    "quota_marks": """SELECT *, CAST(trunc(max_bytes * high) AS BIGINT) AS high_bytes, CAST(trunc(max_bytes * low) AS BIGINT) AS low_bytes,
CASE WHEN max_bytes <= 0 THEN 'max_bytes' WHEN high <= 0 OR high > 1 THEN 'high_water' WHEN low <= 0 OR low >= high THEN 'low_water' END AS error
FROM (SELECT CAST(a AS BIGINT) AS max_bytes, CAST(b AS DOUBLE) AS high, CAST(c AS DOUBLE) AS low FROM (VALUES (1000, 0.9, 0.8), (4194304, 0.9, 0.7), (0, 0.9, 0.7), (-5, 0.9, 0.7), (1000, 0.0, -1.0), (1000, 1.1, 0.5), (1000, 0.9, 0.9), (1000, 0.9, 0.0), (12884901888, 0.9, 0.7)) t(a, b, c))""",
    "over_high_water": f"""WITH {SQL_OBJECTS}, t AS (SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST({BYTES_EACH} * count(*) AS BIGINT) AS quota_bytes FROM objects)
SELECT *, CAST(trunc(CAST(quota_bytes AS DOUBLE) * {HIGH}) AS BIGINT) AS high_water_bytes, CAST(trunc(CAST(quota_bytes AS DOUBLE) * {LOW}) AS BIGINT) AS low_water_bytes, bytes > CAST(trunc(CAST(quota_bytes AS DOUBLE) * {HIGH}) AS BIGINT) AS over_high_water FROM t""",
    "reconcile_rows": _RECONCILED + "SELECT * EXCLUDE (was_indexed) FROM rec",
    "reconcile_counters": _RECONCILED + "SELECT count(*) FILTER (class <> 'removed_stale') AS files_on_disk, CAST(coalesce(sum(size) FILTER (class <> 'removed_stale'), 0) AS BIGINT) AS bytes_on_disk, count(*) FILTER (was_indexed) AS indexed_before, count(*) FILTER (class = 'added') AS added, count(*) FILTER (class = 'removed_stale') AS removed_stale, count(*) FILTER (class = 'size_corrected') AS size_corrected FROM rec",
    "reconcile_survivors": _RECONCILED + "SELECT ns, key, size, created_ns, last_access_ns, greatest(access_count, 1) AS access_count FROM rec WHERE class <> 'removed_stale'",
    "disk_usage": f"WITH {SQL_OBJECTS}, {_DISK} SELECT ns, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM disk GROUP BY ns",
}
