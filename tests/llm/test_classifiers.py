import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import SF
from pyspark.sql import functions as F

from larder.llm import quality, toxicity, training
from larder.llm.queries import documents, labels


def test_fold(spark):
    rows = spark.range(200).select("id", training.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
    assert spark.createDataFrame([(None,)], "id long").select(training.fold(F.col("id"), 5)).first()[0] == 0


def test_sample_is_bounded_and_keeps_one_of_a_family(spark, docs):
    marks = spark.createDataFrame([(i, i % 2) for i in range(55)] + [(3, 7), (4, None), (None, 1)] + [(9, 1)] * 3, "doc_id long, quality int")
    rows = training.sample(docs, marks, "quality", F.lit(True), max_rows=30)
    assert 0 < rows.count() <= 34
    every = training.sample(docs, marks, "quality", F.lit(True))
    assert every.where("text LIKE '% more'").count() <= 2
    assert training.sample(docs, marks, "quality", F.lit(False)).count() == 0


def score_of(machine, index, x):
    total = machine.w0 + sum(machine.w[i] * v for i, v in zip(index, x))
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            total += machine.v[index[a]] @ machine.v[index[b]] * x[a] * x[b]
    return total


def test_linear_time_form_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, quality.RANK)), np.zeros((2, 3)))
    for _ in range(20):
        index, x = rng.choice(50, 12, replace=False), rng.normal(size=12)
        assert m.raw(index, x) == pytest.approx(score_of(m, index, x))


def plain_statistics(text, stated):
    """The numbers about a text's form, one by one."""
    w = re.findall(r"\w+", text.lower())
    ids = [xxhash.xxh32_intdigest(x.encode()) % quality.BUCKETS for x in w]
    n, k, lines, chunks = max(len(text), 1), max(len(w), 1), text.split("\n"), text.split()
    share = lambda kept: sum(map(kept, text)) / n
    doubled, i = 0, 0
    while i + 1 < len(text):
        if re.fullmatch(r"[^\w\s]", text[i]) and text[i] == text[i + 1]:
            doubled, i = doubled + 1, i + 2
        else:
            i += 1
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
    return [
        math.log1p(len(text)), math.log1p(len(w)), sum(map(len, w)) / k, len(set(ids)) / k**0.8 if ids else 1 / k**0.8, sum(a == b for a, b in zip(ids, ids[1:])) / k,
        max(Counter(ids).values(), default=1) / k, len(lines) / k, 1 - len(set(lines)) / len(lines), share(lambda c: c in upper), len(re.findall(r"\d", text)) / n,
        len(re.findall(r"[^\w\s]", text)) / n, doubled / k, sum(not c[-1].isalnum() for c in chunks) / max(len(chunks), 1), text.count("|") / k,
        (n - sum(map(len, chunks))) / n, sum(len(x) < 20 for x in lines) / len(lines), math.log1p(len(text)) - math.log1p(max(stated, 0)) if stated is not None else 0.0, float(stated is not None),
    ]


def test_quality_equals_a_plain_version(spark, docs):
    """Features and scores of whole texts, with every pair of features added by itself (texts of up to 300 words here)."""
    rng = np.random.default_rng(5)
    size = quality.BUCKETS + len(quality.STATISTICS) * (quality.BINS + 1)
    edges = np.sort(rng.normal(0.5, 1, (len(quality.STATISTICS), quality.BINS)), axis=1).astype(np.float32)
    m = quality.Machine(0.2, rng.normal(size=size).astype(np.float32), rng.normal(0, 0.1, (size, quality.RANK)).astype(np.float32), edges)
    checked = 0
    for r in quality.score(docs.where("text IS NULL OR length(text) < 2000"), m).collect():
        text = r["text"] or ""
        ids = sorted({xxhash.xxh32_intdigest(x.encode()) % quality.BUCKETS for x in re.findall(r"\w+", text.lower())})
        bins = [quality.BUCKETS + j * (quality.BINS + 1) + sum(e < np.float32(v) for e in edges[j]) for j, v in enumerate(plain_statistics(text, r["n_chars"]))]
        x = [1 / max(len(ids), 1) ** 0.5] * len(ids) + [0.5] * len(bins)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-score_of(m, ids + bins, x))), abs=1e-5)
        checked += 1
    assert checked > 50


def test_machine_learns_an_interaction():
    """A label that only pairs of words decide."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(3_000):
        a, b = rng.integers(0, 2, 2)
        ids = np.unique(np.concatenate([[1 + a, 3 + b], rng.integers(10, 60, 2)])).astype(np.int32)
        rows.append((ids, np.zeros(len(quality.STATISTICS), np.float32), int(a == b)))
    m = quality.fit(rows[:2_500])
    right = sum((m.raw(*m.inputs(i, s)) > 0) == (y == 1) for i, s, y in rows[2_500:])
    assert right / 500 > 0.95


def test_label_model_weighs_crowds_and_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(4_000) < 0.3
    good = [(rng.random(4_000) < np.where(truth, 0.8, 0.02)) for _ in range(3)]
    noise = rng.random(4_000) < 0.1
    crowd = [noise ^ (rng.random(4_000) < 0.01) for _ in range(6)]
    votes = np.array(good + crowd).T
    noisy = np.where(rng.random(4_000) < 0.15, ~truth, truth).astype(int)
    post, weight = toxicity.label_model(votes, noisy)
    assert ((post > 0.5) == truth).mean() > 0.97 > ((noisy == 1) == truth).mean()
    assert weight[:3].min() > 0.8 and weight[3:].max() < 0.4


def plain_count(name, text):
    """What one voter finds, by the plainest reading of its name."""
    times, term = name.split(" ", 1)
    low, raw = re.findall(r"\w+", text.lower()), re.findall(r"\w+", text)
    bad = set(toxicity.LEXICON)
    at = [i for i, w in enumerate(low) if w in bad]
    near = lambda i, ws: ws[max(0, i - 3) : i + 4]
    fix = lambda w: (w.translate(toxicity.TRICKS), re.sub(r"(\w)\1\1+", r"\1", w))
    if term == "?trick":
        n = sum(w not in bad and bool(bad & set(fix(w))) for w in low + [x for x in re.findall(r"[\w@$]+", text.lower()) if "@" in x or "$" in x])
    elif term == "?address":
        n = sum(bool(set(near(i, low)) & set(toxicity.ADDRESS)) for i in at)
    elif term == "?shout":
        n = sum(any(len(w) > 2 and w.isupper() for w in near(i, raw)) for i in at) if len(low) == len(raw) else 0
    elif term == "?marks":
        n = len(re.findall(r"[!?]{3,}", text))
    elif term == "?threat":
        n = sum(" ".join(low[i : i + 2]) in toxicity.THREATS for i in range(len(low)))
    elif term == "?several":
        n = max(len({low[i] for i in at}) - 1, 0)
    elif term.endswith("*"):
        n = sum(w.startswith(term[:-1]) for w in low)
    else:
        n = low.count(term)
    return min(max(n - int(times) + 1, 0), toxicity.MOST)


def test_voters_equal_a_plain_version():
    rng = random.Random(4)
    pool = ["you", "YOU", "idiot", "IDIOT", "1d10t", "$tupid", "m0r@n", "idiooot", "kill", "hate", "du", "merde", "river", "river", "a@b", "shut", "up", "Stupid!!!", "what?!?", "insult", "threat", "ist", "ßIDIOTA", "İx", "stupidly", "!!", "é"]
    names = [f"{k} {t}" for k in (1, 2, 3) for t in ("idiot", "stup*", "river", "insult", "you", *toxicity.PATTERNS)]
    voters = toxicity.Voters(names)
    hit = set()
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))
        got, n = voters.count(text)
        assert got.tolist() == [plain_count(x, text) for x in names] and n == len(re.findall(r"\w+", text.lower()))
        hit |= {x for x, c in zip(names, got, strict=True) if c}
    assert len(hit) > 25


def test_proposals_equal_a_plain_version(spark, monkeypatch):
    """Log-likelihood ratios of every term, in portions and at once; nested stems go."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        y = int(i % 5 == 0)
        words = [rng.choice(["stone", "river", "lamp", "road", "hall", "gatheren"]) for _ in range(12)]
        rows.append((" ".join(words + [rng.choice(["grublich", "grubheit", "Vex"])] * (y and rng.random() < 0.8) * rng.randrange(1, 4) + ["vexed"] * (rng.random() < 0.1)), y))
    seen = {0: Counter(), 1: Counter()}
    for text, y in rows:
        low = text.lower().split()
        for t in {x for w in low for x in [w, *[w[:k] + "*" for k in toxicity.STEMS if len(w) >= k]]}:
            n = sum(w.startswith(t[:-1]) if t.endswith("*") else w == t for w in low)
            seen[y].update(f"{k} {t}" for k in toxicity.TIMES if n >= k)
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    found, tried = {}, sum(c >= 2 for c in seen[1].values())
    for t, a in seen[1].items():
        c = seen[0][t]
        if a < 2 or a < toxicity.PRECISION * (a + c):
            continue
        share = (a + c) / (n1 + n0)
        g = 2 * sum(k * math.log(k / (n * share)) * (k > 0) if k == n else (k and k * math.log(k / (n * share))) + (n - k) * math.log((n - k) / (n * (1 - share))) for k, n in ((a, n1), (c, n0)))
        if g > 2 * math.log(tried / toxicity.CHANCE):
            found[t] = (g, a + c)
    want = set()
    for t, (_, n) in found.items():
        k, stem = t.split(" ", 1)
        longer = [o for o in found if o != t and o.split(" ", 1)[0] == k and o.split(" ", 1)[1].startswith(stem[:-1]) and len(o.rstrip("*")) >= len(t.rstrip("*"))]
        if not stem.endswith("*") or not any(found[o][1] >= 0.9 * n for o in longer):
            want.add(t)
    df = spark.createDataFrame(rows, "text string, y int").repartition(3)
    got = toxicity.propose(df)
    assert set(got) == want and {"1 grub*", "1 vex"} <= want
    monkeypatch.setattr(toxicity, "TERMS", 20)
    assert toxicity.propose(df) == got


def test_scores_equal_a_plain_version(spark, docs):
    rng = np.random.default_rng(8)
    names = ["1 river", "2 sto*", "1 ?marks", "1 stone"]
    m = toxicity.Model(names, np.array([1.0, 0.5, 1.0, 0.25]), rng.normal(size=9))
    for r in toxicity.score(docs, m).collect():
        text = r["text"] or ""
        c = [plain_count(x, text) for x in names]
        fired = [s * (k > 0) for k, s in zip(c, m.share, strict=True)]
        hits = sum(k * s for k, s in zip(c, m.share, strict=True))
        x = [1, math.log1p(sum(fired)), math.log1p(hits), math.sqrt(hits / max(len(re.findall(r"\w+", text.lower())), 1)), float(not any(c)), *[0.3 * f for f in fired]]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, m.w, strict=True)))), abs=1e-9)


def test_label_model_needs_no_labels_ahead():
    """The label is one voter: where several others agree against it, it is overruled, and it is found to be as good as it is."""
    rng = np.random.default_rng(9)
    truth = rng.random(5_000) < 0.2
    votes = np.array([rng.random(5_000) < np.where(truth, 0.6, 0.02) for _ in range(6)]).T
    noisy = np.where(rng.random(5_000) < 0.1, ~truth, truth).astype(int)
    post, _ = toxicity.label_model(votes, noisy)
    several = votes.sum(axis=1) >= 3
    assert (post[several & (noisy == 0)] > 0.5).mean() > 0.9 and ((post > 0.5) == truth).mean() > 0.97


@pytest.mark.parametrize("module, label, n", [(quality, "quality", 5), (toxicity, "toxic", 4)])
def test_awkward_documents(spark, docs, awkward, none, module, label, n):
    marks = spark.createDataFrame([(i, int("river" in (t or ""))) for i, t, *_ in awkward if i is not None], f"doc_id long, {label} int")
    clashing = docs.withColumns({"score": F.lit("x"), "predicted": F.lit(9)})
    model = module.train(clashing, marks, training.fold(F.col("doc_id"), n) != 0)
    out = module.score(clashing, model)
    assert sorted(out.columns) == sorted(clashing.columns)
    rows = out.collect()
    assert len(rows) == len(awkward) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    again = module.score(docs, module.train(docs.repartition(2), marks, training.fold(F.col("doc_id"), n) != 0))
    assert sorted((str(r["doc_id"]), str(r["text"]), round(r["score"], 9)) for r in again.collect()) == sorted((str(r["doc_id"]), str(r["text"]), round(r["score"], 9)) for r in rows)
    assert module.score(none, model).count() == 0
    blank = module.train(docs, marks.limit(0), F.lit(True))
    assert 0 <= module.score(docs, blank).agg(F.max("score")).first()[0] <= 1
    ones = module.train(docs, marks.withColumn(label, F.lit(1)), F.lit(True))
    assert module.score(docs, ones).agg(F.min("score")).first()[0] > 0.5


def held_out(spark, module, label, n, k):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, marks = documents(spark, sf), labels(spark, sf)
    model = module.train(docs.select("doc_id", "text", "n_chars"), marks, training.fold(F.col("doc_id"), n) != k)
    rows = module.score(docs, model).join(marks, "doc_id").where(training.fold(F.col("doc_id"), n) == k).select(label, "predicted").collect()
    return np.array([(r[0], r[1]) for r in rows]).T


def test_held_out_quality(spark):
    y, p = held_out(spark, quality, "quality", 5, 0)
    assert (y == p).mean() > 0.97 and p[y == 1].mean() > 0.98


def test_held_out_toxicity(spark):
    y, p = held_out(spark, toxicity, "toxic", 4, 2)
    assert (y == p).mean() > 0.97 and p[y == 0].mean() < 0.02 and p[y == 1].mean() > 0.9
