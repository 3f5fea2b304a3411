import pytest

from larder.operators import repair as R
from larder.operators import reports
from larder.sources import generators


def test_passes_cover_the_index_in_turn(spark):
    objects = spark.createDataFrame([("ac" if i < 20 else "cas", f"{i:04d}", 1) for i in range(100)], "ns string, key string, size long")
    ours = objects.where("cast(key as int) % 3 = 0").select("key")
    cursor, seen, passes = ("", ""), [], 0
    while True:
        rows = R.audit_pass(objects, ours, cursor, capacity=5, page=8, budget=20).orderBy("ns", "key").collect()
        if not rows:
            break
        assert len(rows) <= 24 and [r["state"] for r in rows].count("refused") <= 1
        assert [r["state"] for r in rows].count("queued") <= 5
        seen += [r["key"] for r in rows if r["state"] == "queued"]
        cursor = R.next_cursor(R.audit_pass(objects, ours, cursor, 5, 8, 20))
        passes += 1
    assert seen == sorted(r["key"] for r in ours.collect()) and passes >= 7
    assert R.next_cursor(R.audit_pass(objects, ours, ("zz", ""), 5)) == ("", "")


def test_a_budget_counts_whole_pages(spark):
    objects = spark.createDataFrame([("cas", f"{i:05d}", 1) for i in range(6_000)], "ns string, key string, size long")
    assert R.audit_pass(objects, objects.limit(0).select("key"), ("", ""), 10).count() == 5_120


def test_counters_and_metrics(spark):
    events = spark.createDataFrame([("a", "coordinator", "replica_writes", 2), ("a", "coordinator", "replica_failures", 3), ("b", "store", "puts_ok", 1)], "node string, subsystem string, counter string, by long")
    counted = reports.counters(events)
    assert counted.count() == 2 * sum(map(len, reports.COUNTERS.values()))
    usage = spark.createDataFrame([("a", 1, 10, 100, 90, 70)], "node string, objects long, bytes long, quota_bytes long, high_water_bytes long, low_water_bytes long")
    series = reports.derived_metrics(counted, usage)
    got = {(r["node"], r["name"], r["labels"].get("source")): r["value"] for r in series.collect()}
    assert got["a", "replication_attempts_total", None] == 5.0 and got["b", "puts_total", None] == 1.0 and got["a", "hits_total", "peer"] == 0.0 and got["a", "stored_bytes", None] == 10.0
    assert len({(n, s) for _, n, s in got}) == 33


def test_differences_over_a_restart(spark):
    at = lambda *xs: spark.createDataFrame([("n", c, v) for c, v in xs], "node string, counter string, n long")
    got = {r["counter"]: r["delta"] for r in reports.differences(at(("x", 10), ("y", 5)), at(("x", 4), ("y", 7), ("z", 3)), "node").collect()}
    assert got == {"x": 4, "y": 2, "z": 3}


def test_unknown_scenarios_raise(spark):
    rows = spark.createDataFrame([("get",)], "op string")
    assert reports.choose(rows, "op", ["get", "put"]).count() == 1
    with pytest.raises(ValueError):
        reports.choose(rows, "op", ["none"])


def test_mixed_operations(spark):
    rows = generators.mixed_operations(spark, 5_000, 100, 3).collect()
    share = lambda op: sum(r["op"] == op for r in rows) / len(rows)
    assert abs(share("put") - 0.2) < 0.03 and abs(share("miss") - 0.16) < 0.03
    assert all((r["object"] is None) == (r["op"] == "miss") and (r["object"] is None or 0 <= r["object"] < 100) for r in rows)
    assert rows == generators.mixed_operations(spark, 5_000, 100, 3).collect()
