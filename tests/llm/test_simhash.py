import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import simhash as S
from larder.llm.components import components


def plain(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(n, a, b):
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, a, lab[b])
        np.minimum.at(new, b, lab[a])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def by_pairs(f):
    return labels(len(f), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= S.RADIUS))


def test_fingerprints(docs, awkward):
    got = {(r["doc_id"], r["text"]): r["simhash"] for r in S.fingerprints(docs.withColumn("simhash", F.lit("mine"))).collect()}
    for i, t, *_ in awkward:
        if t is None or len(t) < 4_000:
            assert got[i, t] & (1 << 64) - 1 == plain(t)


def test_shuffle_keys_cover_the_ball():
    """Any two within the radius share a key."""
    rng = random.Random(1)
    for _ in range(2_000):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), rng.randrange(0, 5)):
            b ^= 1 << p
        ka, kb = S.shuffle_keys(np.array([a, b], np.uint64))
        assert len(ka) == 131 and set(ka.tolist()) & set(kb.tolist())


@pytest.mark.parametrize("seed, pairs, variants", [(0, 24, 1_000_000), (1, 2, 1_000_000), (2, 2, 5_000)])
def test_links_equal_all_pairs(monkeypatch, seed, pairs, variants):
    monkeypatch.setattr(S, "PAIRS", pairs)
    monkeypatch.setattr(S, "VARIANTS", variants)
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 2**64, 40, dtype=np.uint64)
    f = [c]
    for _ in range(30):
        base = rng.choice(np.concatenate(f) if seed else c[:5], 40)
        for _ in range(rng.integers(1, 6)):
            base = base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))
        f.append(base)
    f = np.unique(np.concatenate(f))
    keys = S.shuffle_keys(f)
    flat, owner = keys.ravel().view(np.int64), np.repeat(f, keys.shape[1]).view(np.int64)
    order = np.argsort(flat, kind="stable")
    batches = [pa.RecordBatch.from_arrays([pa.array(flat[order][i : i + 700]), pa.array(owner[order][i : i + 700])], names=["key", "fp"]) for i in range(0, len(order), 700)]
    out = list(S.met(iter(batches)))
    a, b = (np.concatenate([x.column(i).to_numpy() for x in out]).view(np.uint64) for i in (0, 1))
    assert (labels(len(f), np.searchsorted(f, a), np.searchsorted(f, b)) == by_pairs(f)).all()


@pytest.mark.parametrize("block", range(3))
def test_sliced_run_links_what_meets_only_in_the_block(monkeypatch, block):
    """Pairs three and four bits apart inside the block left out, all else far apart, in a run that takes several slices."""
    monkeypatch.setattr(S, "VARIANTS", 500)
    low, high = S.BLOCKS[block]
    rng = random.Random(block)
    pairs = []
    while len(pairs) < 12:
        a = rng.getrandbits(high - low)
        b = a
        for p in rng.sample(range(high - low), 3 + len(pairs) % 2):
            b ^= 1 << p
        if all((x ^ y).bit_count() > S.RADIUS for pair in pairs for x in pair for y in (a, b)):
            pairs.append((a, b))
    f = np.array([x << low for pair in pairs for x in pair], np.uint64)
    assert len(f) * 200 >= 2 * S.VARIANTS
    a, b = S.near_in(f, np.zeros(len(f), np.int64), low, high)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset((x << low, y << low)) for x, y in pairs}


def test_components_of_documents(spark, docs, awkward, none):
    got = S.near_duplicates(docs.withColumns({"simhash": F.lit(1), "component_id": F.lit(2)})).collect()
    assert len(got) == len(awkward)
    data = [(i, plain(t) if t is None or len(t) < 4_000 else S.fingerprint(t)) for i, t, *_ in awkward]
    lab = by_pairs(np.array([x for _, x in data], np.uint64))
    lowest = {}
    for (i, _), c in zip(data, lab, strict=True):
        if i is not None:
            lowest[c] = min(lowest.get(c, i), i)
    want = sorted((str(i), str(lowest.get(c))) for (i, _), c in zip(data, lab, strict=True))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    assert S.near_duplicates(none).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(200)], [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(3, 3), (None, 4), (7, None)] + [(5, 6)] * 3):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
        nodes = sorted({x for e in real for x in e})
        at = {n: i for i, n in enumerate(nodes)}
        lab = labels(len(nodes), np.array([at[a] for a, _ in real], int), np.array([at[b] for _, b in real], int)) if nodes else []
        assert got == {n: nodes[lab[i]] for n, i in at.items()}
