"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, lattice, licenses, mixing, quality, secrets, simhash, token_counts, topk, toxicity, training
from larder.llm.common import checkpoint, scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(embeddings(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    machine = quality.train(docs, labels(spark, sf_dir), training.fold(F.col("doc_id"), 5) != 0)
    out = quality.score(docs, machine)
    return out.select("doc_id", (training.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).select("doc_id", F.expr(licenses.LAYOUT).alias("path"), "text")
    return licenses.scan(files).select("doc_id", "path", "own_license", "similarity", "license", "inherited_from")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir), training.fold(F.col("doc_id"), 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (training.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = documents(spark, sf_dir).select("doc_id", "text")
    return _spans_by_document(history, checkpoint(secrets.scan(history)[0]))


def _spans_by_document(history: DataFrame, findings: DataFrame) -> DataFrame:
    out = secrets.findings_by_path(history, findings)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(secrets.BASE))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined_spans(base).cast("binary"), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"))


def secrets_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's rows by two runs over a growing history: the second finds the blobs of the first in the ledger's tables and scans the others."""
    history, folder = documents(spark, sf_dir).select("doc_id", "text"), scratch(spark, "ledger")
    secrets.update(history.where("doc_id % 2 = 0"), folder)
    return _spans_by_document(history, checkpoint(secrets.update(history, folder)))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_mixing, op3_topk, op4_simhash, op5_quality, op6_licenses, op7_lattice, op8_toxicity, op9_token_counts, op10_secrets, secrets_ledger)}
#: DuckDB twins, where SQL can express the query.
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op3_topk": topk.ORACLE, "op6_licenses": licenses.ORACLE, "op7_lattice": lattice.ORACLE, "op10_secrets": secrets.ORACLE, "secrets_ledger": secrets.ORACLE}
