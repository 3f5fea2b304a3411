"""Batches of writes into the content store, and the claims check of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.hashing import sha256_hex, valid_key
from larder.functions.rules import admission, content_addressed, valid_namespace
from larder.operators.lineage import checkpoint

#: A number with a unit is a claim; a line with one of these words is none; a claim cites a file under results/.
UNIT = r"[0-9][0-9,.]*\s*(req/s|reqs/s|requests/s|ops/s|MiB/s|GiB/s|KiB/s|MB/s|GB/s|IOPS|ms\b|µs\b|seconds\b|% (faster|lower|reduction|coverage|of statements)|x faster)"
EXEMPT = r"(?i)target|aspiration|goal range|not yet measured|e\.g\.|for example|placeholder|budget|\bwant\b|shields\.io|interval|backoff|timeout|\bdefaults? to\b|configured|\bis set to\b|deadline|grace period"
CITATION = r"(?:\.\./)*(?:bench/)?results/[A-Za-z0-9._/-]+"


def judged(writes: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """writes (seq, ns, key, content, declared) with `written` and `outcome`: invalid_key, a reason of refusal, already_stored or stored.

    An object of the content namespace is stored once: later writes of the same key, in the batch or before it (stored: ns, key), change nothing.
    """
    rows = writes.withColumns({"written": F.octet_length("content").cast("long"), "digest": sha256_hex(F.col("content"))})
    fine = valid_namespace(F.col("ns")) & valid_key(F.col("key"))
    rows = rows.withColumn("reason", F.when(~fine, "invalid_key").otherwise(admission(F.col("ns"), F.col("key"), F.col("declared"), F.col("written"), F.col("digest"), F.lit(limit).cast("long"))))
    cas = (F.col("reason") == "ok") & content_addressed(F.col("ns"))
    first = rows.where(cas).groupBy("ns", "key").agg(F.min("seq").alias("first_seq"))
    have = stored.select("ns", "key").distinct().withColumn("have", F.lit(True))
    known = checkpoint(first.join(have, ["ns", "key"], "full_outer"))  # so that the join below is of two shuffles, which a common key doesn't hold up
    rows = rows.join(known, ["ns", "key"], "left")
    again = cas & (F.col("have").isNotNull() | (F.col("seq") > F.col("first_seq")))
    outcome = F.when(again, "already_stored").when(F.col("reason") == "ok", "stored").otherwise(F.col("reason"))
    return rows.select("seq", "ns", "key", "content", "written", outcome.alias("outcome"))


def put(writes: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """The outcome of each write, see judged; contents don't travel."""
    return judged(writes, stored, limit).drop("content")


def store(writes: DataFrame, stored: DataFrame, limit: int, folder: str) -> DataFrame:
    """Writes what put stores to a table under folder, by namespace and the key's first digits, and returns the outcomes.

    Of several writes of one key outside the content namespace the last is kept. The commit publishes a batch's files together.
    """
    rows = checkpoint(judged(writes, stored, limit))
    last = rows.where("outcome = 'stored'").groupBy("ns", "key").agg(F.max_by(F.struct("content", "written"), "seq").alias("w"))
    out = last.select("ns", F.substring("key", 1, 2).alias("shard"), "key", "w.content", F.col("w.written").alias("size"))
    out.repartitionByRange("ns", "shard", "key").write.mode("append").partitionBy("ns", "shard").parquet(folder)
    return rows.drop("content")


def verified(blobs: DataFrame) -> DataFrame:
    """blobs (ns, key, content) with whether the content has the digest that its key says; null outside the content namespace."""
    return blobs.withColumn("intact", F.when(content_addressed(F.col("ns")), sha256_hex(F.col("content")) == F.col("key")))


def claim_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of lines between blank lines (path, block, line_no, body), a block that opens with a table row belonging to the one before it."""
    lines = texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    blank = F.trim(F.col("line")) == ""
    order = W.partitionBy("path").orderBy("i")
    marked = lines.withColumn("opens", ~blank & F.coalesce(F.lag(blank).over(order), F.lit(True)))
    table = F.ltrim(F.col("line")).startswith("|")
    seen = F.coalesce(F.max(F.when(~blank, 1)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0
    starts = F.col("opens") & ~(table & seen)
    numbered = marked.withColumn("block", F.sum(starts.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where(~blank)
    return numbered.groupBy("path", "block").agg(F.min("i").alias("line_no"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))


def claim_check(texts: DataFrame, results: DataFrame) -> DataFrame:
    """Blocks that make numeric claims (path, line_no, claims) with `problem`: no_citation, missing_file, or null. results: path of each file that exists."""
    rows = claim_blocks(texts).withColumn("claims", F.size(F.filter("lines", lambda x: x["line"].rlike(UNIT) & ~x["line"].rlike(EXEMPT))))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    rows = rows.withColumn("body", body).where((F.col("claims") > 0) & ~F.ltrim(body).startswith("```"))
    cited = F.transform(F.regexp_extract_all("body", F.lit(CITATION), F.lit(0)), lambda r: F.regexp_replace(F.regexp_replace(r, r"[.,)`]+$", ""), r"^.*?(results/)", "$1"))
    refs = rows.select("path", "block", F.explode(F.array_distinct(cited)).alias("ref"))
    known = results.select(F.regexp_replace("path", r"^.*?(results/)", "$1").alias("ref")).distinct().withColumn("exists", F.lit(True))
    checked = refs.join(known, "ref", "left").groupBy("path", "block").agg(F.count_if(F.col("exists").isNull()).alias("missing"))
    out = rows.join(checked, ["path", "block"], "left")
    problem = F.when(F.col("missing").isNull(), "no_citation").when(F.col("missing") > 0, "missing_file")
    return out.select("path", (F.col("line_no") + 1).alias("line_no"), "claims", problem.alias("problem"))
