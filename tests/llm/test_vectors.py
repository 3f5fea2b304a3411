import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import lattice, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype(np.float32)
    v[50:60] = v[50]
    v[60:90] = v[60] + rng.normal(size=(30, dims)).astype(np.float32) * 0.08
    v[90] = v[50] * 3
    rows = [(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)]
    odd = [(1000, None, 1), (1050, [], 1), (1100, [None] * dims, 1), (1150, [float("nan")] + [1.0] * (dims - 1), 1), (1200, [float("inf")] * dims, 1), (1250, [0.0] * dims, 1), (1300, [1.0, 2.0], 1), (1301, [2.0, 4.0], 1), (None, [1.0] * dims, 1), (1350, [-0.0] * dims, 1)]
    return rows + odd + rows[3:5] + [rows[50]]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def exact_top(rows, k, every):
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and fine(v)]
    out = set()
    for i, a in {(i, tuple(a)) for i, a in q if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_topk_equals_all_pairs(frame):
    for k in (1, 5):
        got = [tuple(r) for r in topk.top_k(frame.withColumns({"score": F.lit("x"), "rank": F.lit("y"), "q": F.lit("z")}), F.col("vec_id") % 50 == 0, k=k).collect()]
        want = exact_top(vectors(), k, 50)
        assert {(a, c, d) for a, _, c, d in got} == {(a, c, d) for a, _, c, d in want} and {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}


def test_topk_over_many_shards(frame, monkeypatch):
    for name, value in (("SHARD", 37), ("BLOCK", 3), ("CELL", 2), ("STEP", 3)):
        monkeypatch.setattr(topk, name, value)
    got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in exact_top(vectors(), 5, 50)}


def test_topk_of_large_components_and_small_tables(spark):
    big = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [1e6, -1e6 + 1]), (50, [3.0, 4.0])]
    rows = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    want = sorted(exact_top([(i, v, 0) for i, v in big], 5, 50), key=lambda r: (r[0], r[1]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert topk.top_k(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(rows, F.lit(False)).count() == 0


def test_maxscore_prunes():
    """Terms that can no longer matter are not looked at for all vectors."""
    rng = np.random.default_rng(2)
    postings = rng.integers(-3, 4, (64, 2_000))
    postings[0] = rng.integers(0, 256, 2_000)
    q = np.ones((1, 64), np.int64)
    q[0, 0] = 256
    best = topk.Best(np.array([-1]), 5)
    topk.search(best, q, np.arange(1_000), postings[:, :1_000])
    topk.search(best, q, np.arange(1_000, 2_000), postings[:, 1_000:])
    total = q[0] @ postings
    order = sorted(range(2_000), key=lambda i: (-total[i], i))[:5]
    assert best.found[0] == order and best.scores[0] == [int(total[i]) for i in order]


def exact_links(rows, least):
    keep = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and fine(v) and v and any(v)]
    n, links = len(keep), {}
    for a in range(n):
        for b in range(n):
            if a != b and len(keep[a][1]) == len(keep[b][1]):
                c = keep[a][1] @ keep[b][1] / np.linalg.norm(keep[a][1]) / np.linalg.norm(keep[b][1])
                if c >= least:
                    links.setdefault(a, set()).add(b)
    comp = {}
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        comp[a] = min(keep[x][0] for x in seen)
    return sorted([(keep[a][0], len(links.get(a, ())), comp[a]) for a in range(n)])


@pytest.mark.parametrize("homes, grid", [(4_096, None), (4, None), (4_096, lattice.GRIDS[1][1]), (4, lattice.GRIDS[2][1])])
def test_lattice_links(frame, monkeypatch, homes, grid):
    monkeypatch.setattr(lattice, "HOMES", homes)
    monkeypatch.setattr(lattice, "PAIRS", 50)
    got = lattice.near_duplicates(frame.withColumns({"n_links": F.lit("x"), "kept": F.lit(1)}), grid=grid).collect()
    assert len(got) == len(vectors())
    want = exact_links(vectors(), 0.9)
    linked = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] not in (1000, 1050, 1100, 1150, 1200, 1250, 1350))
    assert linked == want
    for r in got:
        assert r["kept"] == (r["vec_id"] == r["component_id"]) or r["vec_id"] is None
        if r["vec_id"] in (1000, 1050, 1100, 1150, 1200, 1250, 1350):
            assert (r["n_links"], r["component_id"]) == (0, r["vec_id"])


def test_long_vectors(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 3_000))
    v[20:30] = v[20] + rng.normal(size=(10, 3_000)) * 0.1
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(frame).collect())
    assert got == exact_links(rows, 0.9) and sum(r[1] for r in got) == 90
    top = topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()
    floors = [np.floor(256 * r).astype(np.int64) for r in v]
    for q in (0, 20, 40):
        scored = sorted((-int(floors[q] @ f), j) for j, f in enumerate(floors) if j != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in top if r["query_id"] == q) == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]


def family(n, others, noise, seed=6):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n + others, 64))
    v[:n] = v[0] + rng.normal(size=(n, 64)) * noise
    return v


def test_lattice_rows_grow_with_vectors(spark):
    """A family of 2,000 near copies: what leaves the cells is one row at most for each that comes, and links are counted once each."""
    v = family(2_000, 500, 0.2)
    classes = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "id long, copies long, v array<double>")
    grid = lattice.GRIDS[0][1]
    out = lattice.found(classes, 0.9, grid).toPandas()
    assert len(out) <= len(v) * grid.tables * (1 + grid.probes)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert near[:2_000].min() > 1_000
    degree = out.groupby("id")["n"].sum().reindex(range(len(v)), fill_value=0)
    assert (degree <= near).all() and degree.sum() >= 0.999 * near.sum()
    assert set(out["other"].dropna().astype(int)) <= set(range(2_000))


def test_lattice_empty(spark, frame):
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_decode_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (300, 8))
    got = lattice.decode(x)
    near = ((x - got) ** 2).sum(axis=1)
    assert near.max() <= 1 + 1e-9  # the covering radius
    for shift in lattice.minimal_vectors():
        assert (((x - got - shift) ** 2).sum(axis=1) >= near - 1e-9).all()
    doubled = np.rint(2 * got).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all()) and (doubled.sum(axis=1) % 4 == 0).all()


def just_near(n, dims, seed):
    """Pairs with a cosine of just 0.9."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dims))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, 0.9 * a + math.sqrt(1 - 0.81) * b


@pytest.mark.parametrize("grid", [g for _, g in lattice.GRIDS])
@pytest.mark.parametrize("dims", [64, 384])
def test_recall_at_the_threshold(grid, dims):
    a, b = just_near(1_000, dims, 4)
    found = np.zeros(len(a), bool)
    for t in range(grid.tables):
        ca, cb = lattice.cells(a, t, grid), lattice.cells(b, t, grid)
        found |= (ca[:, :1] == cb).any(axis=1) | (ca == cb[:, :1]).any(axis=1)
    assert found.mean() > 0.98


def test_recall_of_the_operator(spark):
    """A table with links at the threshold, near it, and in a family, against brute force."""
    a, b = just_near(500, 64, 8)
    v = np.concatenate([a, b * 1.0000001, family(300, 200, 0.3)])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = int((u @ u.T >= 0.9).sum()) - len(u)
    found = lattice.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    assert 0.98 * links <= found <= links


def test_a_pair_is_found_whatever_else_the_table_holds(spark, monkeypatch):
    """No finer cells for more vectors: here they would lose the pair."""
    monkeypatch.setattr(lattice, "GRIDS", ((2, lattice.GRIDS[0][1]), (1 << 62, lattice.Grid(3, 8, 400.0, 1))))
    a, b = just_near(1, 64, 4)
    others = np.random.default_rng(5).normal(size=(4, 64))
    for more in (others[:0], others):
        v = np.concatenate([a, b * 1.0000001 + a * 0.01, more])
        table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(table).collect()}
        assert got == {0: (1, 0), 1: (1, 0)} | {i: (0, i) for i in range(2, len(v))}
