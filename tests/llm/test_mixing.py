import random
from collections import defaultdict

import pytest
from compare import same
from pyspark.sql import functions as F

from larder.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing out and sharing again what is over the limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(full.values())
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in rest}
        full |= {s: float(most * sizes[s]) for s in over}


def size(t):
    import re

    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def test_targets_and_takes(spark, docs, awkward):
    rows = mixing.taken(mixing.mix(docs)).collect()
    assert len(rows) == len(awkward)
    sizes = defaultdict(int)
    for _, t, _, s, _ in awkward:
        sizes[s] += size(t)
    want = water(sizes)
    took, biggest = defaultdict(int), defaultdict(int)
    source = {(i, size(t)): s for i, t, _, s, _ in awkward}
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        took[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
    for s in sizes:
        assert abs(took[s] - want[s]) <= biggest[s] * 5  # equal rows are taken alike
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(mixing.mix(docs.repartition(2))).collect()))


def test_random_targets(spark):
    rng = random.Random(9)
    for n in (1, 2, 3, 7, 25):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1_000, 100_000]) for i in range(n)}
        frame = spark.createDataFrame(list(sizes.items()), "_source string, source_size long")
        got = {r["_source"]: r["target"] for r in mixing.targets(frame, (5, 2, 1), (3, 2), 2).collect()}
        for s, t in water(sizes).items():
            assert got[s] == pytest.approx(t, abs=1e-6)


def test_equals_twin(spark, duck, tmp_path, docs):
    import duckdb

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(mixing.taken(mixing.mix(docs)), con, mixing.ORACLE)


def test_near_targets_with_many_documents(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(i, rng.choice(["a", "a", "a", "b", "c", None]), "w " * rng.randrange(1, 40)) for i in range(3_000)], "doc_id long, source string, text string")
    out = mixing.taken(mixing.mix(frame)).join(frame.select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.sum("taken").alias("took"), F.first("target").alias("target")).collect():
        assert abs(r["took"] - r["target"]) <= 20


@pytest.mark.parametrize("key", [None, 7])
def test_near_targets_where_rows_share_an_id(spark, key):
    """Rows of one id, or of none, are told apart by their texts."""
    rng = random.Random(5)
    rows = [(key if i % 3 else i, rng.choice(["a", "a", "b"]), f"w{i} " * rng.randrange(1, 40)) for i in range(2_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    took = mixing.apply(mixing.mix(frame), frame).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("took")).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    want = water(sizes)
    assert all(abs(r["took"] - want[r["source"]]) <= 20 for r in took)


def test_apply_repeats_rows(spark, docs):
    clashing = docs.withColumns({"times": F.lit("x"), "target": F.lit("y"), "_source": F.lit("z"), "size": F.lit(1)})
    m = mixing.mix(clashing)
    out = mixing.apply(m, clashing)
    assert out.columns == clashing.columns
    taken = mixing.taken(m).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.words(F.col("text")))).first()[0] == taken


def test_empty_tables(spark, none):
    assert mixing.taken(mixing.mix(none)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", "s")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.taken(mixing.mix(blank)).collect()] == [(0.0, 0)] * 2
