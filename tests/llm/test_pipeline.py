"""The stages against plain versions, and the whole against its parts."""

import re

import numpy as np
import public_tokenizers
import pytest
from compare import SF, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from larder.llm import mixing, near_copies, queries, secrets, simhash, toxicity, training

ORACLES = queries.ORACLES
HARD = r"""AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6}"""


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, ORACLES[name])


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    assert sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "encoding":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"), training.fold(F.col("doc_id"), 4) != 2)
            bad = {r["doc_id"] for r in toxicity.score(before, model).where("score >= 0.3").collect()}
            assert {r["doc_id"] for r in kept[name]} == {r["doc_id"] for r in before.collect()} - bad
        if name == "near_duplicates":
            rows = before.collect()
            f = np.array([simhash.fingerprint(r["text"]) for r in rows], np.uint64)
            near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
            sets = [set(near_copies.shingles(r["text"] or "").tolist()) for r in rows]
            near |= np.array([[bool(a) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
            lab = np.arange(len(f))
            while (new := np.array([lab[n].min() for n in near])).tolist() != lab.tolist():
                lab = new
            groups = {}
            for r, c in zip(rows, lab, strict=True):
                groups[c] = min(groups.get(c, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(groups.values())
        if name == "secrets":
            assert len(kept[name]) == before.count()
            for r in kept[name]:
                assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) and r["n_chars"] == len(r["text"])
            hit = {r["doc_id"] for r in before.collect() if re.search(HARD, r["text"])}
            assert {r["doc_id"] for r in kept[name] if secrets.MASK in r["text"]} == hit
        if name == "mixing":
            take = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.taken(mixing.mix(before)).collect()}
            ids = [r["doc_id"] for r in kept[name]]
            assert all(ids.count(i) == n for i, n in take.items())
        if name == "encoding":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            text = {r["doc_id"]: r["text"] for r in kept["mixing"]}
            for r in kept[name]:
                assert bytes(r["token_ids"]) == np.array(lib.encode(text[r["doc_id"]], add_special_tokens=False).ids, "<u4").tobytes()
    whole = P.run(spark, SF)
    assert sorted((r["doc_id"], bytes(r["token_ids"])) for r in whole.collect()) == sorted((r["doc_id"], bytes(r["token_ids"])) for r in kept["encoding"])


def test_awkward_stages(spark, docs, awkward, none, tmp_path):
    """Nulls, blanks, long texts, repeated rows and extra columns pass; empty tables stay empty."""
    marks = spark.createDataFrame([(i, int("river" in (t or "")), int("stone" in (t or ""))) for i, t, *_ in awkward if i is not None], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs.withColumns({"score": F.lit(1), "size": F.lit("x"), "spans": F.lit(2)}), none):
        now = start
        for n, (name, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{start is docs}-{id(start)}-{n}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
        assert (now.count() == 0) == (start is none)


def test_near_duplicates_leave_one_row_a_group(spark):
    """Of rows repeated under one id and of copies without an id one stays, as of any others."""
    a, b, c = ("the quiet river runs past a stone", "a lamp in the blue hall was lit", "nobody walks along that road today")
    rows = [(7, a), (7, a), (7, a), (9, a), (None, a), (None, b), (None, b), (None, c), (3, c), (3, c + ""), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_duplicates(spark, docs, None).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted([("7", a), ("None", b), ("3", c), ("5", "None")])


def test_workers_need_no_path(tmp_path):
    """A driver elsewhere, whose workers can't see this folder, sends them the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(P.__file__).parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.queries()["op9_token_counts"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200" in out.stdout, out.stderr[-2000:]
