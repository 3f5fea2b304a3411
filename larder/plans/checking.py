"""Admission, parsing, verification and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.functions.hashing import sha256_hex, valid_key
from larder.operators import ingest, ledger, reports
from larder.operators import requests as Q
from larder.plans.base import RUN_SECONDS, SQL_OBJECTS, SQL_PLACED, SQL_REQUESTS, holdings, node_state, objects, requests, table
from larder.sources import files, generators

LIMIT = 8_192
RAM = 4_000_000


def _writes(spark: SparkSession, sf: str) -> DataFrame:
    """A write a document: some to the action namespace, some cut short, some under another document's key, some under no key."""
    n, body = F.col("doc_id"), F.col("text")
    key = F.when(n % 17 == 0, sha256_hex(F.concat(body, F.lit("!")))).when(n % 23 == 0, F.upper(sha256_hex(body))).otherwise(sha256_hex(body))
    declared = F.when(n % 13 == 0, F.lit(-1)).when(n % 19 == 0, F.octet_length(body) + 1).otherwise(F.octet_length(body)).cast("long")
    return table(spark, sf, "documents").where("text IS NOT NULL").select(n.alias("seq"), F.when(n % 11 == 0, "ac").otherwise("cas").alias("ns"), key.alias("key"), body.cast("binary").alias("content"), declared.alias("declared"))


def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.groupBy(sha256_hex(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def put_admission_reasons(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "documents").where("doc_id % 29 = 0 AND text IS NOT NULL").select(F.lit("cas").alias("ns"), sha256_hex(F.col("text")).alias("key"))
    return ingest.put(_writes(spark, sf), stored, LIMIT)


def put_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return put_admission_reasons(spark, sf).groupBy("ns", "outcome").agg(F.count("*").alias("writes"), F.sum("written").alias("bytes"))


def blob_verification(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.verified(_writes(spark, sf)).select("seq", "ns", "intact")


def key_validation(spark: SparkSession, sf: str) -> DataFrame:
    cases = ["", "x", "NOT-HEX", "z" * 64, "a" * 64, "A" * 64, "a" * 63, "a" * 65, "0123456789abcdef" * 4, "a" * 63 + "\n", "a" * 64 + "\n", "../../etc/passwd", None]
    rows = spark.createDataFrame([(c,) for c in cases], "key string")
    return rows.select("key", valid_key(F.col("key")).alias("valid"), F.when(valid_key(F.col("key")), rules.shard_dir(F.col("key"))).alias("shard"))


def path_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Object paths in many spellings, made from pages' urls."""
    k, n = sha256_hex(F.col("url")), F.col("page_id") % 12
    forms = [F.concat(F.lit("/cas/"), k), F.concat(F.lit("/ac/"), k, F.lit("/")), F.concat(F.lit("/cache/cas/"), k), F.concat(F.lit("cas/"), k), F.concat(F.lit("/CAS/"), k), F.concat(F.lit("/cas/"), F.upper(k)), F.concat(F.lit("/cas/"), k, F.lit("/x")), F.lit("/cas"), F.lit("/metrics"), F.concat(F.lit("//cas/"), k), F.concat(F.lit("/cache/cache/ac/"), k), F.concat(F.lit("/other/"), k)]
    path = F.element_at(F.array(*forms), (n + 1).cast("int"))
    ns, key = rules.parse_path(path)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), ns.alias("ns"), key.alias("key"), rules.is_cache_path(path).alias("is_cache_path"))


def _ledger_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Writes of documents in turn, some refused, some of them again later."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", sha256_hex(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("size"))
    first = docs.select(F.col("doc_id").alias("seq"), "key", F.col("key").alias("digest"), "size", F.when(F.col("doc_id") % 7 == 0, 503).when(F.col("doc_id") % 31 == 0, 500).otherwise(201).alias("status"))
    again = docs.where("doc_id % 14 = 0").select((F.col("doc_id") + 1_000_000_000).alias("seq"), "key", F.col("key").alias("digest"), "size", F.lit(200).alias("status"))
    return first.unionByName(again)


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    """A read of each key: most right, some missing, unreachable, damaged or cut."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").groupBy(sha256_hex(F.col("text")).alias("key")).agg(F.min("doc_id").alias("n"), F.min(F.octet_length("text")).cast("long").alias("size"))
    n = F.col("n")
    status = F.when(n % 37 == 0, 404).when(n % 41 == 0, 503).otherwise(200)
    return docs.select("key", status.alias("status"), F.when(n % 43 == 0, F.reverse("key")).otherwise(F.col("key")).alias("digest"), (F.col("size") - (n % 47 == 0).cast("long")).alias("size"), F.when(n % 53 == 0, "connection reset").alias("error"))


def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.corrupted_reads(_reads(spark, sf), ledger.acknowledged(_ledger_writes(spark, sf)))


def refused_not_acked(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.refused(_ledger_writes(spark, sf))


def final_verify(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.final_verification(ledger.acknowledged(_ledger_writes(spark, sf)), _reads(spark, sf))


def final_verify_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every stride-th key of the index in order, by a stride for 5,000, of which there may be more."""
    from larder.operators.repair import subsample

    keys = objects(spark, sf).select("key")
    return subsample(keys, "key", 5_000, keys.count(), capped=False)


def chaos_traffic(spark: SparkSession, sf: str) -> DataFrame:
    return Q.traffic(requests(spark, sf), float(RUN_SECONDS))


def verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts over all combinations of what can have happened."""
    flags = [(a, b, c, d, e) for a in (0, 1) for b in (0, 3) for c in (True, False) for d in (True, False) for e in (0.0, 0.2)]
    rows = spark.createDataFrame(flags, "corrupted long, missing long, evicted boolean, converged boolean, error_rate double")
    v = rules.verdict(F.col("corrupted"), F.lit(0), F.col("missing"), F.col("evicted"), F.lit(True), F.col("converged"), F.lit(True), F.lit(2), F.col("error_rate"))
    return rows.withColumn("verdict", v)


def digest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two listings of documents' digests that differ here and there."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("out-"), F.col("doc_id").cast("string")).alias("name"), sha256_hex(F.col("text")).alias("digest"))
    a = docs.where("doc_id % 61 <> 0").select("name", "digest")
    b = docs.where("doc_id % 67 <> 0").select("name", F.when(F.col("doc_id") % 71 == 0, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"))
    return ledger.listing_diff(a, b)


def page_cache_note(spark: SparkSession, sf: str) -> DataFrame:
    """How far each source's corpus fits a host with 100 bytes of memory a document."""
    sizes = table(spark, sf, "documents").groupBy("source").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    return sizes.select("source", "bytes", rules.page_cache_class(F.col("bytes"), F.lit(RAM // 40)).alias("note"), rules.page_cache_class(F.col("bytes"), F.lit(0)).alias("unknown_host"))


def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(-1, 0), (-2, 1023), (-3, 1024), (-4, 5 << 20), (-5, 3 << 29), (-6, 7 << 30)], "doc_id long, n long"))
    return rows.select("doc_id", text.human_bytes(F.col("n")).alias("human"))


SIZES = ("512", "64KiB", "20GiB", "4MB", "1GB", "1G", "1.5GiB", "1K", "1KB", "1kib", " 10 MiB ", "0", "1B", "2T", "-1", "12x", "", "KiB", "1.5", "-1KiB", "+7", "1e3", "1e3K", ".5K")
SIZE_BYTES = (512, 65536, 21474836480, 4000000, 1000000000, 1073741824, 1610612736, 1024, 1000, 1024, 10485760, 0, 1, 2199023255552, None, None, None, None, None, None, 7, None, 1024000, 512)


def parse_size(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in SIZES], "size_text string")
    return rows.select("size_text", text.parse_size(F.col("size_text")).alias("bytes"))


def parse_peers(spark: SparkSession, sf: str) -> DataFrame:
    """Peers of a list, with how often each name occurs in it."""
    rows = spark.createDataFrame([(1, " a=http://a:1/ , b=http://b:2,, a=http://c:3"), (2, "x=http://x"), (3, "bad,=http://y,z=")], "id long, peers string")
    each = rows.select("id", F.inline(text.parse_peers(F.col("peers"))))
    return each.withColumn("occurs", F.count("*").over(W.partitionBy("id", "name")))


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.sha2("props", 256).alias("key"), "value", "event_type")
    return rows.select("event_id", text.short(F.col("key")).alias("short"), text.short_commit(F.when(F.col("event_id") % 2 == 0, F.col("key"))).alias("commit"), text.milliseconds(F.round(F.col("value") * 1000).cast("long") * 1000 + 999).alias("ms"), text.parse_level(F.upper(F.element_at(F.array(*map(F.lit, ("debug", "info", "warn", "error", "warning", "x"))), (F.col("event_id") % 6 + 1).cast("int")))).alias("level"), text.results_path(F.concat(F.lit("/a/results/"), F.col("event_type"))).alias("path"), text.rate(F.col("event_id"), F.col("event_id") % 3).alias("rate"))


def claim_citation_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with claims of their own length in front: with a citation that exists, one that doesn't, none, or exempt."""
    claims = ["It served {n} ops/s, see `bench/results/run-a.json`.", "It took {n} ms, see results/none.json.", "It took {n} ms.", "The interval is {n} ms.", "Nothing is claimed.", "Source: results/run-a.json\n\n| rate | {n} MiB/s |"]
    n = F.col("doc_id") % len(claims)
    line = F.element_at(F.array(*map(F.lit, claims)), (n + 1).cast("int"))
    texts = table(spark, sf, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("# Title\n\n"), F.replace(line, F.lit("{n}"), F.col("n_chars").cast("string")), F.lit("\n\n"), F.regexp_replace("text", "[0-9%`|]", "")).alias("text"))
    known = spark.createDataFrame([("bench/results/run-a.json",)], "path string")
    return ingest.claim_check(texts, known).withColumn("kind", F.coalesce("problem", F.lit("backed"))).groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("claims").alias("claims"))


def stats_eviction_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes' /stats bodies, made from the copies that they hold and parsed back; one node's body is broken."""
    per = holdings(spark, sf).groupBy("node").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    body = F.to_json(F.struct(F.col("node"), F.struct("objects", "bytes", (F.col("bytes") > F.lit(100)).alias("over_high_water")).alias("usage"), F.struct(F.col("objects").alias("evicted"), F.col("bytes").alias("bytes_reclaimed")).alias("eviction")))
    rows = per.select(F.when(F.col("node") == "node-c", "{broken").otherwise(body).alias("body"))
    return files.eviction_totals(files.parse_stats(rows))


def unreachable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Copies on nodes that can't be reached."""
    return holdings(spark, sf).join(F.broadcast(node_state(spark)), "node").groupBy("reachable").agg(F.count("*").alias("copies"))


def absent_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that no document has."""
    have = table(spark, sf, "documents").where("text IS NOT NULL").select(sha256_hex(F.col("text")).alias("key"))
    return generators.absent_keys(spark, 100, 7).join(have, "key", "left_anti")


def unique_objects(spark: SparkSession, sf: str) -> DataFrame:
    rows = generators.unique_objects(spark, 4, 50, 64)
    return rows.agg(F.count("*").alias("objects"), F.countDistinct("key").alias("distinct_keys"), F.min(F.octet_length("content")).alias("size"))


def scenario_filter(spark: SparkSession, sf: str) -> DataFrame:
    return reports.choose(requests(spark, sf), "op", ["put", "head"]).groupBy("op").agg(F.count("*").alias("n"))


_NAMES = (content_dedup, put_admission_reasons, put_outcomes, blob_verification, key_validation, path_parse, ledger_verify, refused_not_acked, final_verify, final_verify_sample, chaos_traffic, verdict, digest_diff, page_cache_note, human_bytes, parse_size, parse_peers, text_functions, claim_citation_check, stats_eviction_totals, unreachable_nodes, absent_keys, unique_objects, scenario_filter)
QUERIES = {f.__name__: f for f in _NAMES}

_W = f"""w AS (SELECT doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN 'ac' ELSE 'cas' END AS ns, CASE WHEN doc_id % 17 = 0 THEN sha256(text || '!') WHEN doc_id % 23 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS key, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS written,
  CASE WHEN doc_id % 13 = 0 THEN -1 WHEN doc_id % 19 = 0 THEN strlen(text) + 1 ELSE strlen(text) END AS declared FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, CASE WHEN NOT regexp_full_match(key, '[0-9a-f]{{64}}') THEN 'invalid_key' WHEN declared > {LIMIT} OR written > {LIMIT} THEN 'too_large' WHEN declared >= 0 AND written <> declared THEN 'short_write' WHEN ns = 'cas' AND digest <> key THEN 'digest_mismatch' ELSE 'ok' END AS reason FROM w),
f AS (SELECT ns, key, min(seq) AS first_seq FROM r WHERE reason = 'ok' AND ns = 'cas' GROUP BY ns, key),
o AS (SELECT r.seq, r.ns, r.key, r.written, CASE WHEN reason = 'ok' AND r.ns = 'cas' AND (r.key IN (SELECT sha256(text) FROM documents WHERE doc_id % 29 = 0 AND text IS NOT NULL) OR r.seq > f.first_seq) THEN 'already_stored' WHEN reason = 'ok' THEN 'stored' ELSE reason END AS outcome FROM r LEFT JOIN f ON r.ns = f.ns AND r.key = f.key) """
_L = """lw AS (SELECT doc_id AS seq, sha256(text) AS key, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN doc_id % 7 = 0 THEN 503 WHEN doc_id % 31 = 0 THEN 500 ELSE 201 END AS status FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id + 1000000000, sha256(text), strlen(text), 200 FROM documents WHERE doc_id % 14 = 0 AND text IS NOT NULL),
led AS (SELECT key, key AS digest, min_by(size, seq) AS size FROM lw WHERE status IN (200, 201) GROUP BY key),
rd AS (SELECT key, CASE WHEN n % 37 = 0 THEN 404 WHEN n % 41 = 0 THEN 503 ELSE 200 END AS status, CASE WHEN n % 43 = 0 THEN reverse(key) ELSE key END AS digest, size - CASE WHEN n % 47 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN n % 53 = 0 THEN 'connection reset' END AS error
  FROM (SELECT sha256(text) AS key, min(doc_id) AS n, CAST(min(strlen(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)) """
_K = "sha256(url)"
_FORMS = f"['/cas/' || {_K}, '/ac/' || {_K} || '/', '/cache/cas/' || {_K}, 'cas/' || {_K}, '/CAS/' || {_K}, '/cas/' || upper({_K}), '/cas/' || {_K} || '/x', '/cas', '/metrics', '//cas/' || {_K}, '/cache/cache/ac/' || {_K}, '/other/' || {_K}]"
_KEYS = "(VALUES (''), ('x'), ('NOT-HEX'), (repeat('z', 64)), (repeat('a', 64)), (repeat('A', 64)), (repeat('a', 63)), (repeat('a', 65)), (repeat('0123456789abcdef', 4)), (repeat('a', 63) || chr(10)), (repeat('a', 64) || chr(10)), ('../../etc/passwd'), (NULL))"


def _human(n: str) -> str:
    return f"CASE WHEN {n} >= 1073741824 THEN printf('%.1f GiB', {n} / 1073741824) WHEN {n} >= 1048576 THEN printf('%.0f MiB', {n} / 1048576) WHEN {n} >= 1024 THEN printf('%.0f KiB', {n} / 1024) ELSE {n} || ' B' END"


ORACLES = {
    "content_dedup": "SELECT sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "put_admission_reasons": f"WITH {_W} SELECT * FROM o",
    "put_outcomes": f"WITH {_W} SELECT ns, outcome, count(*) AS writes, CAST(sum(written) AS BIGINT) AS bytes FROM o GROUP BY ALL",
    "blob_verification": f"WITH {_W} SELECT seq, ns, CASE WHEN ns = 'cas' THEN digest = key END AS intact FROM w",
    "key_validation": f"SELECT key, coalesce(strlen(key) = 64 AND regexp_full_match(key, '[0-9a-f]{{64}}'), false) AS valid, CASE WHEN regexp_full_match(key, '[0-9a-f]{{64}}') THEN substr(key, 1, 2) || '/' || substr(key, 3, 2) END AS shard FROM {_KEYS} t(key)",
    "path_parse": f"""WITH p AS (SELECT page_id, {_FORMS}[page_id % 12 + 1] AS path FROM pages), s AS (SELECT *, regexp_replace(regexp_replace(path, '^/', ''), '^cache/', '') AS c, regexp_replace(regexp_replace(regexp_replace(path, '^/', ''), '/$', ''), '^cache/', '') AS q FROM p)
SELECT page_id, path, CASE WHEN regexp_full_match(q, '(?i:cas|ac)/[0-9a-f]{{64}}') THEN lower(split_part(q, '/', 1)) END AS ns, CASE WHEN regexp_full_match(q, '(?i:cas|ac)/[0-9a-f]{{64}}') THEN split_part(q, '/', 2) END AS key, c IN ('cas', 'ac') OR starts_with(c, 'cas/') OR starts_with(c, 'ac/') AS is_cache_path FROM s""",
    "ledger_verify": f"WITH {_L} SELECT l.key, l.digest, r.digest AS got_digest, l.size, r.size AS got_size FROM rd r JOIN led l ON r.key = l.key WHERE r.status = 200 AND r.error IS NULL AND (r.digest <> l.digest OR r.size <> l.size)",
    "refused_not_acked": f"WITH {_L} SELECT DISTINCT key FROM lw WHERE status = 503 AND key NOT IN (SELECT key FROM led)",
    "final_verify": f"WITH {_L}, k AS (SELECT CASE WHEN r.error IS NULL AND r.status = 404 THEN 'missing' WHEN r.key IS NULL OR r.error IS NOT NULL OR r.status <> 200 THEN 'unreadable' WHEN r.digest = l.digest THEN 'correct' ELSE 'corrupted' END AS k FROM led l LEFT JOIN rd r ON l.key = r.key) SELECT count(*) AS checked, count(*) FILTER (k = 'correct') AS correct, count(*) FILTER (k = 'corrupted') AS corrupted, count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'unreadable') AS unreadable FROM k",
    "final_verify_sample": f"WITH {SQL_OBJECTS}, n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n, count(*) OVER () AS c FROM objects) SELECT key FROM n WHERE c <= 5000 OR n % (c // 5000) = 0",
    "chaos_traffic": f"""WITH {SQL_REQUESTS}, t AS (SELECT count(*) FILTER (op = 'put') AS writes, count(*) FILTER (op = 'put' AND error IS NULL) AS writes_ok, count(*) FILTER (op = 'put' AND status = 503) AS writes_refused, count(*) FILTER (op = 'put' AND error IS NOT NULL AND status <> 503) AS write_errors,
 count(*) FILTER (op <> 'put') AS reads, count(*) FILTER (op <> 'put' AND error IS NULL AND status = 200) AS read_hits, count(*) FILTER (op <> 'put' AND error IS NULL AND status = 404) AS read_misses, count(*) FILTER (op <> 'put' AND error IS NOT NULL) AS read_errors, count(*) FILTER (error IS NOT NULL AND status >= 500) AS server_errors FROM requests)
SELECT *, (writes + reads) / CAST({RUN_SECONDS} AS DOUBLE) AS ops_per_second, (write_errors + read_errors) / CAST(writes + reads AS DOUBLE) AS error_rate FROM t""",
    "verdict": """SELECT CAST(a AS BIGINT) AS corrupted, CAST(b AS BIGINT) AS missing, c AS evicted, d AS converged, CAST(e AS DOUBLE) AS error_rate, CASE WHEN a > 0 THEN 'FAIL: corrupted data was served' WHEN b > 0 AND NOT c THEN 'FAIL: acknowledged objects are gone and no eviction was observed' WHEN NOT d THEN 'FAIL: objects were still under-replicated' WHEN e = 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict
FROM (VALUES (0), (1)) t1(a) CROSS JOIN (VALUES (0), (3)) t2(b) CROSS JOIN (VALUES (true), (false)) t3(c) CROSS JOIN (VALUES (true), (false)) t4(d) CROSS JOIN (VALUES (0.0), (0.2)) t5(e)""",
    "digest_diff": """WITH d AS (SELECT doc_id, 'out-' || doc_id AS name, sha256(text) AS digest FROM documents WHERE text IS NOT NULL), a AS (SELECT * FROM d WHERE doc_id % 61 <> 0), b AS (SELECT doc_id, name, CASE WHEN doc_id % 71 = 0 THEN reverse(digest) ELSE digest END AS digest FROM d WHERE doc_id % 67 <> 0)
SELECT coalesce(a.name, b.name) AS name, a.digest AS digest_a, b.digest AS digest_b, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'differs' END AS difference FROM a FULL OUTER JOIN b ON a.name = b.name WHERE b.name IS NULL OR a.name IS NULL OR a.digest <> b.digest""",
    "page_cache_note": f"SELECT source, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CASE WHEN coalesce(sum(strlen(text)), 0) / {RAM // 40}.0 < 0.5 THEN 'WARM' WHEN coalesce(sum(strlen(text)), 0) / {RAM // 40}.0 < 1.5 THEN 'MIXED' ELSE 'COLD-ISH' END AS note, 'unknown' AS unknown_host FROM documents GROUP BY source",
    "human_bytes": f"SELECT doc_id, {_human('n')} AS human FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES (-1, 0), (-2, 1023), (-3, 1024), (-4, 5242880), (-5, 1610612736), (-6, 7516192768)))",
    "parse_size": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST({'NULL' if b is None else b} AS BIGINT))" for s, b in zip(SIZES, SIZE_BYTES, strict=True)) + ") t(size_text, bytes)",
    "parse_peers": "SELECT CAST(id AS BIGINT) AS id, name, url, CAST(occurs AS BIGINT) AS occurs FROM (VALUES (1, 'a', 'http://a:1', 2), (1, 'b', 'http://b:2', 1), (1, 'a', 'http://c:3', 2), (2, 'x', 'http://x', 1), (3, NULL, NULL, 2), (3, NULL, 'http://y', 2), (3, 'z', NULL, 1)) t(id, name, url, occurs)",
    "text_functions": "SELECT event_id, substr(sha256(props), 1, 12) AS short, CASE WHEN event_id % 2 = 0 THEN substr(sha256(props), 1, 12) ELSE 'unknown' END AS \"commit\", CAST(round(value * 1000) AS BIGINT) / 1000 AS ms, ['debug', 'info', 'warn', 'error', 'warn', 'info'][event_id % 6 + 1] AS level, 'results/' || event_type AS path, coalesce(event_id / nullif(CAST(event_id % 3 AS DOUBLE), 0), 0.0) AS rate FROM events",
    "claim_citation_check": "SELECT kind, count(*) AS blocks, count(*) AS claims FROM (SELECT ['backed', 'missing_file', 'no_citation', NULL, NULL, 'backed'][doc_id % 6 + 1] AS kind FROM documents WHERE text IS NOT NULL) WHERE kind IS NOT NULL GROUP BY kind",
    "stats_eviction_totals": SQL_PLACED + "SELECT count(*) AS objects_evicted, CAST(sum(size) AS BIGINT) AS bytes_reclaimed, true AS any_over_high_water, true AS observed FROM holdings WHERE node <> 'node-c'",
    "unreachable_nodes": SQL_PLACED + "SELECT n.reachable, count(*) AS copies FROM holdings h JOIN nodes n ON h.node = n.node GROUP BY 1",
    "absent_keys": "SELECT sha256('miss/7/' || i) AS key FROM range(100) t(i) WHERE sha256('miss/7/' || i) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)",
    "unique_objects": "SELECT CAST(200 AS BIGINT) AS objects, CAST(200 AS BIGINT) AS distinct_keys, 64 AS size",
    "scenario_filter": f"WITH {SQL_REQUESTS} SELECT op, count(*) AS n FROM requests WHERE op IN ('put', 'head') GROUP BY op",
}
