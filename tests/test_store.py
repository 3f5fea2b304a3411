import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import eviction as E
from larder.operators import index as I
from larder.operators import ingest, lineage, ranges, repair
from larder.operators import reconcile as R
from larder.sources import files
from larder.streaming import store as S


def rows(rng, n, spread=50):
    return [("cas" if rng.random() < 0.7 else "ac", f"{i:064x}", rng.choice([0, 1, 65_536, rng.randrange(1 << 27)]), 10**18, 10**18 + rng.randrange(spread) * 10**12, 1) for i in range(n)]


def sweep(objects, max_bytes, high, low, batch):
    """The loop that the query stands for."""
    used = sum(r[2] for r in objects)
    if used <= int(max_bytes * high):
        return []
    must, freed, left, gone = used - int(max_bytes * low), 0, sorted(objects, key=lambda r: (r[4], r[0], r[1])), []
    while freed < must and left:
        now, left = left[:batch], left[batch:]
        heap = [(r[4] - int(math.log2(1 + r[2] / 65_536) * 3.6e12), r[0], r[1], r[2]) for r in now]
        heapq.heapify(heap)
        while heap and freed < must:
            _, ns, key, size = heapq.heappop(heap)
            gone.append((ns, key))
            freed += size
    return gone


@pytest.mark.parametrize("fan", [1_024, 2])
def test_victims_equal_the_loop(spark, monkeypatch, fan):
    monkeypatch.setattr(E, "FAN", fan)
    rng = random.Random(3)
    for n, batch, quota in ((0, 8, 100), (1, 8, 1), (40, 8, 10**8), (300, 16, 10**9), (300, 512, 3 * 10**9), (200, 16, 10**13)):
        data = rows(rng, n)
        got = E.victims(spark.createDataFrame(data, I.OBJECTS), quota, 0.9, 0.7, batch=batch).orderBy("order").collect()
        want = sweep(data, quota, 0.9, 0.7, batch)
        assert [r["order"] for r in got] == list(range(1, len(got) + 1))
        assert {(r["ns"], r["key"]) for r in got} == set(want) and len(got) == len(want)


def test_scores(spark):
    sizes = [0, 65_536, 65_536 * 3, 64 << 20, 65_535, 123_456_789]
    got = E.with_score(spark.createDataFrame([(s, 10**18) for s in sizes], "size long, last_access_ns long")).collect()
    for r in got:
        assert abs(10**18 - r["score"] - math.log2(1 + r["size"] / 65_536) * 3.6e12) < 1.01
    assert [10**18 - r["score"] for r in got[:3]] == [0, 3_600_000_000_000, 7_200_000_000_000]


def test_touches_count_flushes_not_reads(spark):
    objects = spark.createDataFrame([("cas", "a", 1, 5, 10, 1), ("cas", "b", 1, 5, 10, 1)], I.OBJECTS)
    touches = spark.createDataFrame([("cas", "a", t) for t in range(100)] + [("cas", "b", 3), ("cas", "gone", 9)], "ns string, key string, at_ns long")
    got = {r["key"]: (r["last_access_ns"], r["access_count"]) for r in I.flush_touches(objects, touches).collect()}
    assert got == {"a": (99, 2), "b": (10, 2)}


def test_index_changes(spark):
    objects = spark.createDataFrame([("cas", "a", 1, 5, 10, 4)], I.OBJECTS)
    writes = spark.createDataFrame([("cas", "a", 7, 20), ("cas", "a", 8, 30), ("ac", "z", 2, 40)], "ns string, key string, size long, at_ns long")
    got = sorted(tuple(r) for r in I.upsert(objects, writes).collect())
    assert got == [("ac", "z", 2, 40, 40, 1), ("cas", "a", 8, 5, 30, 4)]
    assert I.remove(objects, objects.select("ns", "key").union(objects.select("ns", "key"))).count() == 0
    assert I.coldest(objects, 0).count() == 0 and I.coldest(objects, -1).count() == 0
    assert I.totals(objects.limit(0)).first()["bytes"] == 0
    assert I.page_after(objects, "cas", "a", 5).count() == 0 and I.page_after(objects, "", "", 5).count() == 1


def test_coldest_is_a_top_n_plan(spark):
    plan = I.coldest(spark.createDataFrame([], I.OBJECTS), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_reconcile(spark):
    disk = spark.createDataFrame([("cas", "a", 1, 100), ("cas", "b", 9, 100), ("ac", "n", 3, 100)], "ns string, key string, size long, mod_ns long")
    objects = spark.createDataFrame([("cas", "a", 1, 5, 10, 4), ("cas", "b", 1, 5, 10, 4), ("cas", "gone", 1, 5, 10, 4)], I.OBJECTS)
    rec = R.reconcile(disk, objects)
    assert {r["key"]: r["class"] for r in rec.collect()} == {"a": "kept", "b": "size_corrected", "n": "added", "gone": "removed_stale"}
    c = R.counters(rec).first()
    assert (c["files_on_disk"], c["bytes_on_disk"], c["indexed_before"], c["added"], c["removed_stale"], c["size_corrected"]) == (3, 13, 3, 1, 1, 1)
    assert sorted(tuple(r) for r in R.survivors(rec).collect()) == [("ac", "n", 3, 100, 100, 1), ("cas", "a", 1, 5, 10, 4), ("cas", "b", 9, 5, 10, 4)]
    assert R.counters(R.reconcile(disk.limit(0), objects.limit(0))).first()["bytes_on_disk"] == 0


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([("cas", f"{k:064x}", 10**18 + n, "get") for k in range(n, 40)], S.ACCESSES).coalesce(1).write.mode("append").parquet(folder)
    first = spark.createDataFrame([("cas", f"{k:064x}", 1_000, 5, 10, 1) for k in range(50)], I.OBJECTS)
    snaps = S.Snapshots(spark, str(tmp_path / "index"), first)
    q = S.flush_touches(S.accesses(spark, folder, 1), snaps, str(tmp_path / "cp"), None)
    q.awaitTermination()
    counts = {r["access_count"]: r["count"] for r in snaps.read(2).groupBy("access_count").count().collect()}
    assert counts == {1: 10, 2: 1, 3: 1, 4: 38}
    snaps = S.Snapshots(spark, str(tmp_path / "index2"), first)
    q = S.sweep(S.accesses(spark, folder), snaps, str(tmp_path / "cp2"), 40_000, 0.9, 0.5, None)
    q.awaitTermination()
    left = snaps.read(0)
    assert left.agg(F.sum("size")).first()[0] == 20_000 and left.where("last_access_ns = 10").count() == 0


def test_memory_peaks(spark, tmp_path):
    folder = str(tmp_path / "m")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 10) AS ts, 'n' AS node, id AS rss_bytes FROM range(20)").write.parquet(folder)
    q = S.memory_peaks(spark.readStream.schema("ts timestamp, node string, rss_bytes long").parquet(folder)).writeStream.format("memory").queryName("peaks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["rss_bytes"] for r in spark.table("peaks").orderBy("start").collect()] == [4, 9, 14, 19]


def test_convergence_poll(spark):
    states = iter([False, False, True, True])
    waits = []
    out = S.convergence_poll(lambda: spark.createDataFrame([(next(states),)], "converged boolean"), 10, lambda: waits.append(1))
    assert out.first()["converged"] and len(waits) == 2


def test_running_sums(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(5), rng.randrange(100), rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "n int, k int, x long, y long").repartition(3)
    got = {r["n"]: (r["sx"], r["sy"]) for r in ranges.running(df, ["k", "n"], {"sx": "x", "sy": "y"}).collect()}
    a = b = 0
    for n, _, x, y in sorted(data, key=lambda r: (r[1], r[0])):
        assert got[n] == (a, b)
        a, b = a + x, b + y
    assert ranges.running(df.limit(0), ["k", "n"], {"sx": "x"}).count() == 0


def test_audit_loop_goes_on_where_it_stopped(spark, tmp_path):
    objects = spark.createDataFrame([("cas", f"{k:03}", k) for k in range(50)], "ns string, key string, size long")
    ours = objects.where("size % 3 = 0").select("key")
    folder = str(tmp_path / "audit")
    first = repair.audit_loop(objects, ours, folder, 1_000, 4, 8, passes=2)
    assert sorted(r["key"] for r in first.collect()) == [f"{k:03}" for k in range(16)]
    rows = repair.audit_loop(objects, ours, folder, 1_000, 4, 8).collect()
    assert sorted((r["pass"], r["key"], r["state"]) for r in rows) == [(k // 8, f"{k:03}", "queued" if k % 3 == 0 else "not_ours") for k in range(50)]


@pytest.mark.parametrize("capacity, most, at_a_time", [(1 << 30, 8, 4_096), (3, 8, 4), (1, 8, 4_096), (0, 8, 4_096), (2, 0, 4_096)])
def test_audit_loop_gives_the_rows_of_single_passes(spark, tmp_path, monkeypatch, capacity, most, at_a_time):
    rng = random.Random(capacity + most)
    data = [(rng.choice(["ac", "cas"]), f"{k:03}", k) for k in range(60)] + [(None, "x", 1)]
    objects = spark.createDataFrame(data, "ns string, key string, size long").repartition(3)
    ours = objects.where("size % 5 < 2 and ns is not null").select("key")
    expected, cursor, n = [], ("", ""), 0
    while True:
        rows = repair.audit_pass(objects, ours, cursor, capacity, 4, most).collect()
        expected += [(n, r["ns"], r["key"], r["size"], r["state"]) for r in rows]
        taken = [(r["ns"], r["key"]) for r in rows if r["state"] != "refused"]
        if not taken:
            break
        cursor, n = max(taken), n + 1
    monkeypatch.setattr(repair, "ROUND", at_a_time)
    folder = str(tmp_path / "audit")
    repair.audit_loop(objects, ours, folder, capacity, 4, most, passes=3)
    for _ in range(2):  # again: nothing more, and nothing twice
        got = repair.audit_loop(objects, ours, folder, capacity, 4, most)
        assert sorted((r["pass"], r["ns"], r["key"], r["size"], r["state"]) for r in got.collect()) == sorted(expected)


def test_audit_loop_takes_many_passes_a_job(spark, tmp_path):
    """The number of jobs doesn't grow with that of passes."""
    objects = spark.range(2_000).selectExpr("'cas' AS ns", "lpad(cast(id as string), 6, '0') AS key", "id AS size")
    ours, jobs = objects.where("size % 3 = 0").select("key"), []
    for name, most in (("few", 1_000), ("many", 10)):
        spark.sparkContext.setJobGroup(f"audit-{name}", name)
        assert repair.audit_loop(objects, ours, str(tmp_path / name), 1 << 30, 10, most).agg({"pass": "max"}).first()[0] == 2_000 // most - 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"audit-{name}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 5


def test_stored_writes(spark, tmp_path):
    """The last of several writes of a key outside the content namespace stays; what is refused or known is not written."""
    import hashlib

    key = {b: hashlib.sha256(b).hexdigest() for b in (b"one", b"two", b"six")}
    writes = [(1, "cas", key[b"one"], b"one", 3), (2, "cas", key[b"one"], b"one", 3), (3, "cas", key[b"two"], b"bad", 3), (4, "ac", key[b"two"], b"first", 5), (5, "ac", key[b"two"], b"second", 6), (6, "cas", key[b"six"], b"six", 3)]
    known = spark.createDataFrame([("cas", key[b"six"])], "ns string, key string")
    out = ingest.store(spark.createDataFrame(writes, "seq long, ns string, key string, content binary, declared long"), known, 100, str(tmp_path / "s"))
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["stored", "already_stored", "digest_mismatch", "stored", "stored", "already_stored"]
    back = files.stored(spark, str(tmp_path / "s")).collect()
    assert sorted((r["ns"], bytes(r["content"]), r["shard"]) for r in back) == [("ac", b"second", key[b"two"][:2]), ("cas", b"one", key[b"one"][:2])]


def test_a_cluster_needs_a_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())
