import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from larder.llm import near_copies as N
from larder.llm import simhash


def similarity(a, b):
    x, y = (set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def family(rng, n, copies, changed):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for p in rng.sample(range(0, n, 7), changed):
            words[p] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def groups(near):
    """The smallest member of each one's component, by brute force."""
    label = np.arange(len(near))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    return label


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_leaves_one_of_each_group(spark):
    """Against all pairs: fingerprints within four bits, or similarities of 0.8 and more, of which most are beyond the fingerprints."""
    rng = random.Random(3)
    texts = [t for k in range(25) for t in family(rng, 120, 3, 1 + k % 5)] + ["", "  ", "short one", "short one", "Short  one"]
    rng.shuffle(texts)
    f = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    alike = np.array([[bool(a.strip() and b.strip()) and similarity(a, b) >= 0.8 for b in texts] for a in texts])
    bits = np.bitwise_count(f[:, None] ^ f[None, :])
    assert (alike & (bits > 4)).sum() > 40 and (~alike & (bits > 4)).sum() > 1_000
    got = sorted(r["doc_id"] for r in P.drop_near_duplicates(spark, frame(spark, texts), None).collect())
    assert got == sorted(set(groups(alike | (bits <= 4)).tolist()))


@pytest.mark.parametrize("pairs, homes", [(24, 4_096), (3, 4_096), (3, 8), (2, 3)])
def test_full_bands(spark, monkeypatch, pairs, homes):
    """Runs compared in pairs, by leaders, and dealt to several tasks leave the same groups as all pairs."""
    rng = random.Random(4)
    texts = family(rng, 200, 40, 1) + family(rng, 200, 40, 5) + family(rng, 150, 12, 4)
    alike = np.array([[similarity(a, b) >= 0.8 for b in texts] for a in texts])
    f = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    want = sorted(set(groups(alike | (np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)).tolist()))
    monkeypatch.setattr(N, "PAIRS", pairs)
    monkeypatch.setattr(N, "HOMES", homes)
    docs = frame(spark, texts).select("doc_id", "text", F.format_string("%04d", "doc_id").alias("_row"))
    assert sorted(int(r["_row"]) for r in simhash.survivors(docs).collect()) == want


def test_leaders_cover_a_run():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (6, N.BANDS * N.ROWS), dtype=np.uint8)
    sigs = base[rng.integers(0, 6, 500)]
    change = rng.random(sigs.shape) < rng.choice([0.0, 0.05, 0.15, 0.25], 500)[:, None]
    sigs[change] = rng.integers(0, 256, change.sum(), dtype=np.uint8)
    a, b, agree = N.led(sigs)
    assert (a < b).all() and (N.agreeing(sigs[a], sigs[b]) == agree).all() and len(set(b.tolist())) == len(b)
    sure, maybe = N.least_agreeing(N.SURE), N.least_agreeing(N.MAYBE)
    leaders = sorted(set(range(500)) - set(b[agree >= sure].tolist()))
    for i in range(500):
        near = [int(N.agreeing(sigs[i], sigs[j])) for j in leaders if j < i]
        told = agree[b == i]
        assert (max(near, default=0) >= maybe) == bool(len(told)) and (not len(told) or told[0] == max(near))


def test_bands():
    rng = np.random.default_rng(1)
    met = far = 0
    for _ in range(200):
        s = rng.integers(0, 2**64, 200, dtype=np.uint64)
        (a, x), (b, y) = N.sketch(s[:180]), N.sketch(s[20:])  # 160 of 200
        met += bool(set(a.tolist()) & set(b.tolist()))
        agree = N.agreeing(*(np.frombuffer(v, np.uint8) for v in (x, y)))
        far += not N.least_agreeing(N.MAYBE) <= agree < N.least_agreeing(N.SURE)
    assert met >= 199 and far <= 2
    assert len(N.sketch(N.shingles("  "))[0]) == 0
