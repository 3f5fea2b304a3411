"""The store's tables as projections of the driver's tables, in Spark and as DuckDB common table expressions.

Contents are documents' texts; the larger index is orders, with lineitems as accesses; requests are events; nodes are literal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.hashing import MEMBER_SEEDS, sha256_hex
from larder.operators import placement

Query = Callable[[SparkSession, str], DataFrame]
NODES = ("node-a", "node-b", "node-c")
RUN_SECONDS = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cluster(spark: SparkSession, n: int = 3) -> DataFrame:
    return placement.members(spark, list(MEMBER_SEEDS)[:n])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    whole = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, size): distinct texts by digest."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(sha256_hex(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("size")).distinct()


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index before any access: orders."""
    created = micros(F.col("o_orderdate")) * 1000
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, "ac").otherwise("cas").alias("ns"),
        order_key(F.col("o_orderkey")).alias("key"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("size"),
        created.alias("created_ns"),
        created.alias("last_access_ns"),
        F.lit(1).cast("long").alias("access_count"),
    )


def order_key(n: Column) -> Column:
    return sha256_hex(F.concat(F.lit("object-"), n.cast("string")))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ns, key, at_ns): one access a lineitem."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return rows.select(F.when(F.col("l_orderkey") % 3 == 0, "ac").otherwise("cas").alias("ns"), order_key(F.col("l_orderkey")).alias("key"), (micros(F.col("l_shipdate")) * 1000).alias("at_ns"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    failed = kind == "error"
    pick = lambda by, *xs: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    us = micros(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        n.alias("seq"),
        us.alias("ts_us"),
        (us * 1000).alias("start_ns"),
        F.expr("cast(date_format(ts, 'yyyyMMdd') as long)").alias("run"),
        F.when(kind.isin("view", "signup"), "get").when(kind == "click", "head").when(kind == "purchase", "put").otherwise(pick(n, "get", "put")).alias("op"),
        F.when(n % 5 == 0, "ac").otherwise("cas").alias("ns"),
        F.when(kind == "signup", 404).when(kind == "purchase", 201).when(failed, pick(n, 500, 503, 429, 504)).otherwise(200).alias("status"),
        pick(F.col("user_id"), "", "coordinator", "replica", "read").alias("hop"),
        F.floor(F.col("value") * 1024).cast("long").alias("bytes"),
        (F.round(F.col("value") * 1000).cast("long") * 1000).alias("latency_ns"),
        F.when(failed, F.concat(pick(n, "dial tcp: connection refused by peer ", "context deadline exceeded at ", "unexpected end of stream from "), F.col("user_id").cast("string"))).alias("error"),
    )


def node_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("node-a", True), ("node-b", True), ("node-c", False)], "node string, reachable boolean")


def dropped(key: Column, node: Column) -> Column:
    """The copies that are missing: a deterministic seventh or so, by the digest of key and node."""
    return F.substring(sha256_hex(F.concat(key, node)), 1, 1).isin("0", "1")


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, ns, key, size): the placement's copies, with gaps."""
    held = placement.holders(contents(spark, sf_dir), cluster(spark), 2)
    return held.where(~dropped(F.col("key"), F.col("name"))).select(F.col("name").alias("node"), F.lit("cas").alias("ns"), "key", "size")


# The same for DuckDB.

SQL_CONTENTS = "contents AS (SELECT DISTINCT sha256(text) AS key, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL)"
SQL_OBJECTS = """objects AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'ac' ELSE 'cas' END AS ns, sha256('object-' || o_orderkey) AS key, CAST(floor(o_totalprice * 100) AS BIGINT) AS size,
    epoch_us(o_orderdate) * 1000 AS created_ns, epoch_us(o_orderdate) * 1000 AS last_access_ns, CAST(1 AS BIGINT) AS access_count FROM orders)"""
SQL_ACCESSES = "accesses AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'ac' ELSE 'cas' END AS ns, sha256('object-' || l_orderkey) AS key, epoch_us(l_shipdate) * 1000 AS at_ns FROM lineitem)"
SQL_TOUCHED = "touched AS (SELECT o.ns, o.key, o.size, o.created_ns, greatest(o.last_access_ns, coalesce(a.at_ns, o.last_access_ns)) AS last_access_ns, o.access_count + CASE WHEN a.at_ns IS NULL THEN 0 ELSE 1 END AS access_count FROM objects o LEFT JOIN (SELECT ns, key, max(at_ns) AS at_ns FROM accesses GROUP BY ns, key) a ON o.ns = a.ns AND o.key = a.key)"
SQL_REQUESTS = """requests AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, epoch_us(ts) * 1000 AS start_ns, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS run,
    CASE WHEN event_type IN ('view', 'signup') THEN 'get' WHEN event_type = 'click' THEN 'head' WHEN event_type = 'purchase' THEN 'put' ELSE ['get', 'put'][event_id % 2 + 1] END AS op,
    CASE WHEN event_id % 5 = 0 THEN 'ac' ELSE 'cas' END AS ns,
    CASE WHEN event_type = 'signup' THEN 404 WHEN event_type = 'purchase' THEN 201 WHEN event_type = 'error' THEN [500, 503, 429, 504][event_id % 4 + 1] ELSE 200 END AS status,
    ['', 'coordinator', 'replica', 'read'][user_id % 4 + 1] AS hop, CAST(floor(value * 1024) AS BIGINT) AS bytes, CAST(round(value * 1000) AS BIGINT) * 1000 AS latency_ns,
    CASE WHEN event_type = 'error' THEN ['dial tcp: connection refused by peer ', 'context deadline exceeded at ', 'unexpected end of stream from '][event_id % 3 + 1] || user_id END AS error FROM events)"""


def sql_members(n: int = 3) -> str:
    return "members AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS UBIGINT))" for k, v in list(MEMBER_SEEDS.items())[:n]) + ") t(name, seed))"


SQL_SEED = "CAST(('0x' || substr(k.key, 1, 16)) AS UBIGINT)"


def sql_ranked(keys: str, n: int = 3, name: str = "ranked", members: str = "members") -> str:
    """A common table expression: key, name, rank (keys are digests)."""
    w1 = f"SELECT k.key, m.name, xor({SQL_SEED}, m.seed) AS x FROM {keys} k CROSS JOIN {members} m"
    w2 = f"SELECT key, name, CAST((CAST(xor(x, x >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS UBIGINT) AS x FROM ({w1})"
    w3 = f"SELECT key, name, CAST((CAST(xor(x, x >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS UBIGINT) AS x FROM ({w2})"
    return f"{name} AS (SELECT key, name, CAST(row_number() OVER (PARTITION BY key ORDER BY xor(x, x >> 31) DESC, name) AS INTEGER) AS rank FROM ({w3}))"


SQL_HOLDINGS = "holdings AS (SELECT r.name AS node, 'cas' AS ns, r.key, c.size FROM ranked r JOIN contents c ON r.key = c.key WHERE r.rank <= 2 AND substr(sha256(r.key || r.name), 1, 1) NOT IN ('0', '1'))"
SQL_NODES = "nodes AS (SELECT * FROM (VALUES ('node-a', true), ('node-b', true), ('node-c', false)) t(node, reachable))"
SQL_PLACED = f"WITH {SQL_CONTENTS}, {sql_members()}, {sql_ranked('contents')}, {SQL_HOLDINGS}, {SQL_NODES}"
