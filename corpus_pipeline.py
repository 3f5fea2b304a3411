"""A corpus pipeline: toxicity, near duplicates, secrets, the mix of sources, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written
as Parquet and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, mixing, secrets, simhash, toxicity, training
from larder.llm.common import checkpoint, discard, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. It learns from labelled documents outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training.fold(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def kept(docs: DataFrame, survivors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that survivors names by the hash of the whole row, equal rows once. Texts travel once."""
    named = docs.select(*COLUMNS).withColumn("_row", F.sha2(F.to_json(F.struct(*COLUMNS)), 256))
    rows = named.groupBy("_row").agg(F.any_value(F.struct(*COLUMNS)).alias("_all"))
    return rows.join(checkpoint(survivors(named)), "_row", "left_semi").select(*[F.col(f"_all.{c}") for c in COLUMNS])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (op4's fingerprints within four bits, or five-word shingles with a similarity of 0.8 or
    more): the one with the smallest id, rows without an id last."""
    return kept(docs, simhash.survivors)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; the stated length follows the text where it changes."""
    masked = secrets.redact(docs.select(*COLUMNS, F.length("text").alias("_before")), rules=secrets.MASKED)
    n = F.length("text").cast("long")
    return masked.withColumn("n_chars", F.when(n == F.col("_before"), F.col("n_chars")).otherwise(n)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.apply(mixing.mix(docs), docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: ids as packed little-endian unsigned 32-bit integers, and their number."""
    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "source", "n_tokens", "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The first stage's classifier can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; only the last one's table stays."""
    folder, before = scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            discard(spark, before)
        before = written
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
