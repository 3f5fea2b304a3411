"""Extra columns under the names that the operators use inside: none crashes, and results are those without them."""

import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from larder.llm import bpe, lattice, licenses, mixing, quality, secrets, simhash, token_counts, topk, toxicity
from larder.llm.common import checkpoint

#: Each module's columns are added for its own operator; more columns at once would only make plans slow.
INSIDE = {m: (Path(P.__file__).parent / f"larder/llm/{m}.py").read_text() for m in ("bpe", "components", "lattice", "licenses", "mixing", "near_copies", "quality", "secrets", "simhash", "token_counts", "topk", "toxicity", "training")}
INPUTS = {"doc_id", "text", "lang", "source", "n_chars", "path", "vec_id", "embedding"}


def names(*modules):
    found = {n.lower() for m in modules for n in re.findall(r'(?:alias|withColumn|withColumnRenamed)\((?:"[^"]*", )?"(\w+)"', INSIDE[m]) + re.findall(r'"(_\w+)"', INSIDE[m])}
    return sorted(found - INPUTS)


def clashing(df, *modules):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names(*modules)) if n not in {c.lower() for c in df.columns}])


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def marks(docs, label):
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("text").contains("river"), F.lit(False)).cast("int").alias(label))


OPERATORS = {
    "bpe": lambda d: rows(bpe.encode(d, public_tokenizers.path("word_bpe_49k.json"), decoded=True), "doc_id", "n_tokens", "token_ids", "decoded"),
    "mixing": lambda d: rows(mixing.taken(mixing.mix(d)), "doc_id", "size", "target", "taken") + rows(mixing.apply(mixing.mix(d), d), "doc_id", "text"),
    "simhash": lambda d: rows(simhash.near_duplicates(d), "doc_id", "simhash", "component_id"),
    "quality": lambda d: [r[:40] for r in rows(quality.score(d, quality.train(d, clashing(marks(d, "quality"), "training"), F.lit(True))), "doc_id", "predicted")],
    "toxicity": lambda d: rows(toxicity.score(d, toxicity.train(d, clashing(marks(d, "toxic"), "training"), F.lit(True))), "doc_id", "predicted"),
    "token_counts": lambda d: rows(token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit"),
    "secrets": lambda d: rows(secrets.findings_by_path(d, checkpoint(secrets.scan(d)[0])), "doc_id", "blob_id", "spans") + rows(secrets.redact(d), "doc_id", "text"),
    "licenses": lambda d: rows(licenses.scan(d.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))), "path", "own_license", "license", "inherited_from"),
}


def test_names_are_found():
    assert {"_row", "_path", "_above"} <= set(names("licenses")) and "blob_id" in names("secrets") and len(names("mixing")) > 20


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    modules = {"simhash": ("simhash", "components"), "quality": ("quality", "training"), "toxicity": ("toxicity", "training")}.get(name, (name,))
    assert OPERATORS[name](clashing(docs, *modules)) == OPERATORS[name](docs)


@pytest.mark.parametrize("stage, modules", [(0, ("toxicity", "training")), (1, ("simhash", "near_copies")), (2, ("secrets",)), (3, ("mixing",)), (4, ("bpe",))])
def test_stages(spark, docs, tmp_path, stage, modules):
    marks(docs, "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    one, two = (P.STAGES[stage][1](spark, d, str(tmp_path)) for d in (clashing(docs, *modules), docs))
    assert one.columns == two.columns and rows(one, *one.columns) == rows(two, *two.columns)


def test_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    for run, module in ((lambda v: topk.top_k(v, F.col("vec_id") % 20 == 0), "topk"), (lattice.near_duplicates, "lattice")):
        one, two = run(clashing(vectors, module)), run(vectors)
        assert one.columns == two.columns and rows(one, *one.columns) == rows(two, *two.columns)
