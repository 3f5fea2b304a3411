"""Placement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.hashing import flipped_seed_bits, member_seed
from larder.operators import placement as P
from larder.plans.base import SQL_CONTENTS, SQL_PLACED, cluster, contents, sql_members, sql_ranked, table
from larder.sources import generators

GOLDEN_KEYS = 50_000
SQL_GOLDEN = f"golden AS (SELECT sha256('object-' || i) AS key FROM range({GOLDEN_KEYS}) t(i))"


def placement_load(spark: SparkSession, sf: str) -> DataFrame:
    c = cluster(spark)
    return P.load(P.primary(contents(spark, sf), c), c)


def placement_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return P.imbalance(placement_load(spark, sf))


def placement_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Few keys over eight members, some of which stay idle."""
    c = cluster(spark, 8)
    return P.load(P.primary(generators.sequence_keys(spark, 5).select("key"), c), c)


def placement_owners(spark: SparkSession, sf: str) -> DataFrame:
    return P.ranked(contents(spark, sf).select("key"), cluster(spark))


def placement_goldens(spark: SparkSession, sf: str) -> DataFrame:
    """Loads of 50,000 numbered keys on clusters of 3, 4, 5 and 8: published figures."""
    keys = generators.sequence_keys(spark, GOLDEN_KEYS).select("key")
    return _union(P.imbalance(P.load(P.primary(keys, c), c)) for c in (cluster(spark, n) for n in (3, 4, 5, 8)))


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def holder_goldens(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of the same keys when a member joins: published figures."""
    keys = generators.sequence_keys(spark, GOLDEN_KEYS).select("key")
    return _union(P.movement(keys, cluster(spark, n), cluster(spark, n + 1), 2).withColumn("members", F.lit(n)) for n in (3, 4, 5))


def key_movement_growth(spark: SparkSession, sf: str) -> DataFrame:
    m = P.movement(contents(spark, sf).select("key"), cluster(spark, 3), cluster(spark, 4), 2)
    return m.withColumns({"moved_share": F.col("moved") / F.col("keys"), "expected_share": F.lit(1) / F.lit(4)})


def key_movement_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Of the keys of the member that leaves, and of the others, how many get another primary."""
    keys = contents(spark, sf).select("key")
    before, after = (P.primary(keys, cluster(spark, n)).select("key", F.col("name").alias(a)) for n, a in ((4, "old"), (3, "new")))
    both = before.join(after, "key")
    return both.groupBy((F.col("old") == "node-d").alias("was_on_leaver")).agg(F.count("*").alias("keys"), F.count_if(F.col("old") != F.col("new")).alias("moved"))


def holders_array(spark: SparkSession, sf: str) -> DataFrame:
    lists = P.holder_lists(contents(spark, sf).select("key"), cluster(spark), 2)
    return lists.select("key", "holder_names", F.col("holders")[0].alias("first_holder"), F.size("holders").alias("n"))


def self_holds(spark: SparkSession, sf: str) -> DataFrame:
    return P.holds(contents(spark, sf).select("key"), cluster(spark), "node-b", 2)


def member_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Members by name, among names of which one is unknown."""
    asked = spark.createDataFrame([("node-b",), ("node-x",)], "name string")
    known = F.broadcast(cluster(spark).withColumn("url", F.concat(F.lit("http://"), "name", F.lit(":8080"))))
    return asked.join(known.select("name", "url"), "name", "left")


def non_hex_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are no digests are placed by their own digest: here, the documents' ids as text."""
    keys = table(spark, sf, "documents").select(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key")).distinct()
    c = cluster(spark)
    return P.load(P.primary(keys, c), c)


def member_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of the nation names as members of a cluster whose prefix is "larder/"."""
    return table(spark, sf, "nation").select("n_name", F.lower(F.lpad(F.hex(member_seed(F.col("n_name"), "larder/")), 16, "0")).alias("seed"))


def bit_flip_average(spark: SparkSession, sf: str) -> DataFrame:
    """Bits that change in a weight, over all keys, when one bit of the seed does."""
    return flipped_seed_bits(contents(spark, sf).select("key")).agg(F.sum("flipped").alias("flipped_bits"), F.count("*").alias("keys"), (F.sum("flipped") / F.count("*")).alias("average"))


def node_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Copies and bytes that each node would hold of two copies of everything."""
    held = P.holders(contents(spark, sf), cluster(spark), 2)
    return held.groupBy("name").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))


QUERIES = {f.__name__: f for f in (placement_load, placement_imbalance, placement_zero_fill, placement_owners, placement_goldens, holder_goldens, key_movement_growth, key_movement_loss, holders_array, self_holds, member_lookup, non_hex_keys, member_seeds, bit_flip_average, node_bytes)}

_LOAD = "SELECT m.name, CAST(count(r.key) AS BIGINT) AS keys FROM {m} m LEFT JOIN {r} r ON m.name = r.name AND r.rank = 1 GROUP BY m.name"
_IMBALANCE = "SELECT count(*) AS members, CAST(sum(keys) AS BIGINT) AS total, min(keys) AS min_load, max(keys) AS max_load, coalesce(CAST(max(keys) * count(*) AS DOUBLE) / nullif(CAST(sum(keys) AS DOUBLE), 0), 0.0) AS imbalance FROM ({load})"


def _cluster(n: int) -> str:
    return sql_members(n).replace("members AS", f"m{n} AS") + ", " + sql_ranked("golden", n, f"r{n}", f"m{n}")


def _moves(a: str, b: str) -> str:
    lists = lambda r: f"SELECT key, max(CASE WHEN rank = 1 THEN name END) AS p, list_sort(list(name)) AS s FROM {r} WHERE rank <= 2 GROUP BY key"
    return f"SELECT count(*) AS keys, count(*) FILTER (x.p <> y.p) AS moved, count(*) FILTER (x.s <> y.s) AS holder_sets_changed FROM ({lists(a)}) x JOIN ({lists(b)}) y ON x.key = y.key"


_TWO = f"WITH {SQL_CONTENTS}, {sql_members(3).replace('members AS', 'm3 AS')}, {sql_members(4).replace('members AS', 'm4 AS')}, {sql_ranked('contents', 3, 'r3', 'm3')}, {sql_ranked('contents', 4, 'r4', 'm4')} "
_MIX = "CAST((CAST(xor({x}, {x} >> {n}) AS UHUGEINT) * {c}) % 18446744073709551616 AS UBIGINT)"


def _flip_sql() -> str:
    step = lambda inner, n, c: f"SELECT key, s, {_MIX.format(x='x', n=n, c=c)} AS x FROM ({inner})"
    base = "SELECT key, s, CASE WHEN s = 1 THEN xor(seed, CAST(1 AS UBIGINT)) ELSE seed END AS x FROM (SELECT key, CAST(('0x' || substr(key, 1, 16)) AS UBIGINT) AS seed FROM contents), (VALUES (0), (1)) t(s)"
    last = step(step(base, 30, 13787848793156543929), 27, 10723151780598845931)
    return f"WITH {SQL_CONTENTS}, w AS (SELECT key, s, xor(x, x >> 31) AS w FROM ({last})) SELECT CAST(sum(bit_count(xor(a.w, b.w))) AS BIGINT) AS flipped_bits, count(*) AS keys, sum(bit_count(xor(a.w, b.w))) / count(*) AS average FROM w a JOIN w b ON a.key = b.key AND a.s = 0 AND b.s = 1"


ORACLES = {
    "placement_load": SQL_PLACED + _LOAD.format(m="members", r="ranked"),
    "placement_imbalance": SQL_PLACED + _IMBALANCE.format(load=_LOAD.format(m="members", r="ranked")),
    "placement_zero_fill": f"WITH few AS (SELECT sha256('object-' || i) AS key FROM range(5) t(i)), {sql_members(8)}, {sql_ranked('few')} " + _LOAD.format(m="members", r="ranked"),
    "placement_owners": SQL_PLACED + "SELECT key, name, rank FROM ranked",
    "placement_goldens": f"WITH {SQL_GOLDEN}, {', '.join(map(_cluster, (3, 4, 5, 8)))} " + " UNION ALL ".join(_IMBALANCE.format(load=_LOAD.format(m=f"m{n}", r=f"r{n}")) for n in (3, 4, 5, 8)),
    "holder_goldens": f"WITH {SQL_GOLDEN}, {', '.join(map(_cluster, (3, 4, 5, 6)))} " + " UNION ALL ".join(f"SELECT *, {n} AS members FROM ({_moves(f'r{n}', f'r{n + 1}')})" for n in (3, 4, 5)),
    "key_movement_growth": _TWO + f"SELECT *, moved / keys AS moved_share, CAST(1 AS DOUBLE) / 4 AS expected_share FROM ({_moves('r3', 'r4')})",
    "key_movement_loss": _TWO + "SELECT x.name = 'node-d' AS was_on_leaver, count(*) AS keys, count(*) FILTER (x.name <> y.name) AS moved FROM r4 x JOIN r3 y ON x.key = y.key AND x.rank = 1 AND y.rank = 1 GROUP BY 1",
    "holders_array": SQL_PLACED + "SELECT key, string_agg(name, ',' ORDER BY rank) AS holder_names, max(CASE WHEN rank = 1 THEN name END) AS first_holder, CAST(count(*) AS INTEGER) AS n FROM ranked WHERE rank <= 2 GROUP BY key",
    "self_holds": SQL_PLACED + "SELECT key FROM ranked WHERE rank <= 2 AND name = 'node-b'",
    "member_lookup": "SELECT a.name, m.url FROM (VALUES ('node-b'), ('node-x')) a(name) LEFT JOIN (VALUES ('node-a', 'http://node-a:8080'), ('node-b', 'http://node-b:8080'), ('node-c', 'http://node-c:8080')) m(name, url) ON a.name = m.name",
    "non_hex_keys": f"WITH ids AS (SELECT DISTINCT sha256('DOC-' || doc_id) AS key FROM documents), {sql_members()}, {sql_ranked('ids')} " + _LOAD.format(m="members", r="ranked"),
    "member_seeds": "SELECT n_name, substr(sha256('larder/' || n_name), 1, 16) AS seed FROM nation",
    "bit_flip_average": _flip_sql(),
    "node_bytes": SQL_PLACED + "SELECT r.name, count(*) AS copies, CAST(sum(size) AS BIGINT) AS bytes FROM ranked r JOIN contents c ON r.key = c.key WHERE rank <= 2 GROUP BY r.name",
}
