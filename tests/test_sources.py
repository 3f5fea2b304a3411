import hashlib
import json

from pyspark.sql import functions as F

from larder.operators import ingest, ledger
from larder.sources import files, generators


def test_object_tree(spark, tmp_path):
    root = tmp_path / "store"
    keys = []
    for ns, body in (("cas", b"one"), ("cas", b"two"), ("ac", b"three")):
        k = hashlib.sha256(body).hexdigest()
        keys.append((ns, k, len(body)))
        d = root / ns / k[:2] / k[2:4]
        d.mkdir(parents=True, exist_ok=True)
        (d / k).write_bytes(body if body != b"two" else b"rot")
        (d / "incoming-1").write_bytes(b"partial")
    got = files.object_tree(spark, str(root)).select("ns", "key", "size").collect()
    assert sorted(map(tuple, got)) == sorted(keys)
    left = files.temporary_files(spark, str(root)).first()
    assert (left["files"], left["bytes"]) == (3, 21)
    intact = {r["key"]: r["intact"] for r in ingest.verified(files.blobs(spark, str(root))).collect()}
    assert [intact[k] for _, k, _ in keys] == [True, False, None]
    scan = files.object_tree(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[-1]
    listing = files.output_digests(spark, str(root)).where("name NOT LIKE 'incoming%'")
    assert ledger.listing_diff(listing, listing).count() == 0


def test_json_sources(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text("\n".join(json.dumps(x) for x in [{"time": "2024-01-01T00:00:00Z", "level": "INFO", "msg": "request", "method": "GET", "path": "/cas/x", "status": 200, "bytes_out": 5, "duration_ms": 1.25}, {"msg": "started"}]))
    assert [(r["status"], r["duration_ms"]) for r in files.access_log(spark, str(log)).collect()] == [(200, 1.25)]
    events = tmp_path / "bep.json"
    counts = lambda *c: {"id": {"buildMetrics": {}}, "buildMetrics": {"actionSummary": {"runnerCount": [{"name": n, "count": k} for n, k in c]}}}
    events.write_text("\n".join(json.dumps(x) for x in [counts(("total", 1)), {"id": {}}, counts(("total", 9), ("remote cache hit", 6), ("linux-sandbox", 2), ("worker", 1), ("internal", 3))]))
    bep = files.build_events(spark, str(events)).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    assert tuple(files.runner_counts(bep, "seq").first()) == (6, 3, 3, 9)
    assert tuple(files.runner_counts(bep.limit(0), "seq").first()) == (0, 0, 0, 0)
    fio = tmp_path / "fio.json"
    fio.write_text(json.dumps({"fio version": "3", "jobs": [{"jobname": "r", "read": {"iops_mean": 1.5, "bw": 7, "clat_ns": {"percentile": {"50.000000": 10}}}}]}, indent=1))
    r = files.fio_jobs(spark, str(fio)).first()
    assert (r["name"], r["read_lat_ns_p50"], r["read_lat_ns_p99"], r["write_bw_kib_s"]) == ("r", 10.0, None, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    assert len(files.write_report(df, str(tmp_path / "r"), "t1")) == 2 and len(files.write_report(df, str(tmp_path / "r"), "t2", smoke=True)) == 1
    assert spark.read.json(str(tmp_path / "r/latest")).count() == 2
    assert files.markdown_table(df, "name").first()[0] == "| name | n |\n|---|---|\n| a | 1 |\n| b | 2 |"
    m = spark.createDataFrame([("x_total", {"b": "2", "a": "1"}, 3.0), ("y", {}, 1.5)], "name string, labels map<string,string>, value double")
    files.write_metrics(m, str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ['x_total{a="1",b="2"} 3.0', "y 1.5"]
    assert sorted((r["name"], r["metric_value"]) for r in files.metrics_text(spark, str(tmp_path / "m")).collect()) == [("x_total", 3.0), ("y", 1.5)]
    files.write_access_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    odd = spark.createDataFrame([("x", {"path": 'a"b\\c\nd'}, 1.0)], "name string, labels map<string,string>, value double")
    files.write_metrics(odd, str(tmp_path / "odd"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "odd")).collect()] == ['x{path="a\\"b\\\\c\\nd"} 1.0']
    assert files.host_facts(spark, {"cpus": 8, "model": None}).first()["host"] == {"cpus": "8", "model": None}


def test_generators(spark):
    rows = generators.corpus(spark, "c", 20, 100, 1).collect()
    assert all(len(r["content"]) == 100 and hashlib.sha256(bytes(r["content"])).hexdigest() == r["key"] for r in rows) and len({r["key"] for r in rows}) == 20
    assert [r["key"] for r in generators.corpus(spark, "c", 5, 100, 1).collect()] == [r["key"] for r in rows[:5]]
    edges = generators.layered_graph(spark, 280, 8, 3, 1).collect()
    layer = lambda i: i * 8 // 280
    assert edges and all(layer(e["target"]) == layer(e["dep"]) + 1 for e in edges)
