import math
import random

from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.operators import ingest
from larder.operators import repair as R
from larder.operators import requests as Q
from larder.plans.checking import _human


def test_latency_goldens(spark):
    ms = lambda xs: spark.createDataFrame([(x * 1_000_000,) for x in xs], "latency_ns long")
    r = Q.latency_summary(ms(range(1, 101))).first()
    assert (r["count"], r["mean_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"], r["max_ms"]) == (100, 50.5, 50.0, 95.0, 99.0, 100.0)
    assert Q.latency_summary(ms([1, 1, 1, 1, 1000])).first()["p99_ms"] == 1000.0
    assert set(Q.latency_summary(ms([])).first()) == {0, 0.0}


def test_percentiles_are_nearest_rank(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 10, 99, 1000):
        xs = sorted(rng.randrange(10**9) for _ in range(n))
        r = Q.latency_summary(spark.createDataFrame([(x,) for x in xs], "latency_ns long")).first()
        for name, p in Q.PERCENTILES.items():
            assert r[name] == xs[min(max(math.ceil(p * n), 1), n) - 1] // 1000 / 1000


def test_percentiles_by_group_over_many_buckets(spark, monkeypatch):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.choice([5, 1_000_000, rng.randrange(10**7)])) for _ in range(3_000)] + [("c", 7), ("a", None)]
    for bits in (16, 4):
        monkeypatch.setattr(Q, "FINE_BITS", bits)
        got = {r["g"]: r for r in Q.percentiles(spark.createDataFrame(data, "g string, v long"), "v", {"p0": 0.0, "half": 0.5, "p99": 0.99, "all": 1.0}, "g").collect()}
        for g in ("a", "b", "c", None):
            xs = sorted(v for k, v in data if k == g and v is not None)
            rank = lambda p: xs[min(max(math.ceil(p * len(xs)), 1), len(xs)) - 1]  # noqa: B023, E731
            r = got[g]
            assert (r["count"], r["total"], r["min"], r["max"]) == (len(xs), sum(xs), xs[0], xs[-1])
            assert (r["p0"], r["half"], r["p99"], r["all"]) == (rank(0.0), rank(0.5), rank(0.99), rank(1.0))


def test_median_run(spark):
    runs = spark.createDataFrame([(1, 100.0), (2, 900.0), (3, 200.0)], "run int, ops_per_sec double")
    r = Q.median_run(runs).first()
    assert (r["run"], r["relative_range"]) == (3, 4.0)
    assert Q.median_run(runs.where("run < 3")).first()["run"] == 2  # the upper of two


def test_histogram_counts_all(spark):
    xs = [99_999, 100_000, 100_001, 10_000_000_000, 10_000_000_001]
    got = Q.latency_histogram(spark.createDataFrame([(x,) for x in xs], "latency_ns long")).collect()
    by = {r["le_ns"]: r["count"] for r in got}
    assert len(by) == 17 and by[100_000] == 2 and by[250_000] == 3 and by[10_000_000_000] == 4 and by[None] == 5


def test_in_flight(spark):
    reqs = [("g", 0, 10), ("g", 5, 10), ("g", 10, 1), ("h", 3_599_999_999_999, 10), ("h", 3_600_000_000_001, 1)]
    got = {r["op"]: r["peak"] for r in Q.in_flight_peak(spark.createDataFrame(reqs, "op string, start_ns long, latency_ns long"), "op").collect()}
    assert got == {"g": 2, "h": 2}


def test_three_valued_audit(spark):
    expected = spark.createDataFrame([("k", n) for n in "abc"], "key string, node string")
    holdings = spark.createDataFrame([("a", "k"), ("c", "k")], "node string, key string")
    nodes = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "node string, reachable boolean")
    assert {r["node"]: r["state"] for r in R.audit(expected, holdings, nodes).collect()} == {"a": "present", "b": "absent", "c": "unreachable"}
    assert [tuple(r) for r in R.repair_tasks(expected, holdings, nodes, "a").collect()] == [("k", "b")]
    assert R.repair_tasks(expected, holdings, nodes, "b").count() == 0  # b holds no copy to send


def test_reads(spark):
    ranking = spark.createDataFrame([("k", n, i) for i, n in enumerate("abc", 1)], "key string, name string, rank int")
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", True)], "node string, reachable boolean")
    reads = spark.createDataFrame([("k", "b", ""), ("k", "b", "read"), ("k", "c", "")], "key string, node string, hop string")
    at = lambda held: [(r["source"], r["outcome"]) for r in R.read_source(reads, ranking, spark.createDataFrame([(h, "k") for h in held], "node string, key string"), nodes).orderBy("node", "hop").collect()]
    assert at("c") == [("c", "peer"), (None, "miss"), ("c", "local")]
    assert at("a") == [(None, "unavailable"), (None, "miss"), (None, "unavailable")]


def test_subsample(spark):
    keys = spark.range(10).select(F.col("id").alias("k"))
    pick = lambda n, **kw: [r["k"] for r in R.subsample(keys, "k", n, 10, **kw).orderBy("k").collect()]
    assert pick(3) == [0, 3, 6] and pick(3, capped=False) == [0, 3, 6, 9] and pick(20) == list(range(10)) and pick(0) == []


def test_settings():
    good = dict(node_name="a", listen_addr=":1", data_dir="/d", max_bytes=1, max_object_bytes=1, replica_count=1, peers=[("a", "http://a:1")])
    assert rules.Settings(**good).problems() == []
    assert rules.Settings(**good | {"peers": [("a", "http://a"), ("a", "ftp://a")], "low_water": 0.95}).problems() == ["low water is outside (0, high water)", "a peer's name occurs twice", "a peer's url is not http(s) with a host"]
    assert "replica count exceeds the cluster" in rules.Settings(**good | {"replica_count": 2}).problems()


def test_metric_lines(spark):
    lines = ["# HELP x y", 'process_resident_memory_bytes{node="a b"} 1.5e+07', "plain 3", "bad line x", "nospace", ""]
    from larder.sources.files import parse_metrics

    got = [tuple(r) for r in parse_metrics(spark.createDataFrame([(x,) for x in lines], "value string"), F.col("value")).collect()]
    assert got == [("process_resident_memory_bytes", 1.5e7), ("plain", 3.0)]


def test_writes_in_a_batch(spark):
    import hashlib

    def w(seq, ns, body, declared=None, key=None):
        return (seq, ns, key or hashlib.sha256(body).hexdigest(), bytearray(body), len(body) if declared is None else declared)

    data = [w(1, "cas", b"a"), w(2, "cas", b"a"), w(3, "ac", b"a"), w(4, "ac", b"a"), w(5, "cas", b"b", key="0" * 64), w(6, "cas", b"c", declared=9), w(7, "cas", b"d" * 50), w(8, "cas", b"e", declared=99), w(9, "xx", b"a"), w(10, "cas", b"have"), w(11, "cas", b"f", declared=-1)]
    stored = spark.createDataFrame([("cas", hashlib.sha256(b"have").hexdigest())], "ns string, key string")
    got = {r["seq"]: r["outcome"] for r in ingest.put(spark.createDataFrame(data, "seq long, ns string, key string, content binary, declared long"), stored, 40).collect()}
    assert got == {1: "stored", 2: "already_stored", 3: "stored", 4: "stored", 5: "digest_mismatch", 6: "short_write", 7: "too_large", 8: "too_large", 9: "invalid_key", 10: "already_stored", 11: "stored"}


def test_rfc3339(spark):
    r = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678901' AS t").select(text.rfc3339(F.col("t"))).first()
    assert r[0] == "2024-01-02T03:04:05.678901Z"


def test_human_bytes_rounds_halves_to_even(spark, duck):
    """As C does, of the exact value: 2.5 KiB is 2 KiB."""
    ties = [k * unit + unit // 2 for unit in (1 << 10, 1 << 20) for k in (1, 2, 3, 4, 1_022, 1_023)] + [(1 << 30) * k // 4 for k in (5, 7, 9, 11, 4_001)]
    sizes = sorted({n + d for n in ties for d in (-1, 0, 1)} | {0, 1, 1_023, 1_024, (1 << 20) - 1, (1 << 30) - 1, 1 << 53, 9007199415802266, 9007222501251482, (1 << 63) - 1})
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(text.human_bytes(F.col("n"))).collect()]
    c = lambda n: "%.1f GiB" % (n / (1 << 30)) if n >= 1 << 30 else "%.0f MiB" % (n / (1 << 20)) if n >= 1 << 20 else "%.0f KiB" % (n / (1 << 10)) if n >= 1 << 10 else f"{n} B"  # noqa: E731, UP031
    assert got == [c(n) for n in sizes]
    assert got == [duck.execute(f"SELECT {_human('n')} FROM (SELECT CAST({n} AS BIGINT) AS n)").fetchone()[0] for n in sizes]
    assert spark.range(1).select(text.human_bytes(F.lit(None).cast("long"))).first()[0] is None
