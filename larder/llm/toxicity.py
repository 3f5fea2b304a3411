"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters find something once, twice or more often. Lexicons of four languages and patterns (tricks of spelling, an insult
addressed or shouted, rows of marks, threats) stand whatever the labels say; words and word stems are proposed beside them from labelled
training rows where their excess among toxic ones could hardly be chance, since insults that no lexicon has are found only so. The label
model takes each voter, the label being one of them and no more than that, to fire with one rate on toxic and another on clean text
(estimated by expectation maximisation), and voters that fire together more than their class
explains to be correlated, which shrinks what they add. A logistic classifier is then trained on the
posterior labels, and scores texts by what voters find in them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import extended, mapped, texts, with_fields, without
from larder.llm.training import MAX_ROWS, sample, sigmoid, words

#: Insults that are voters whatever the labels say, in four languages; words that address someone; threats, as two words.
LEXICONS = {
    "en": ("bastard", "clown", "creep", "crap", "disgusting", "dumb", "filthy", "fool", "freak", "idiot", "imbecile", "jerk", "loser", "lunatic", "moron", "pathetic", "pig", "rat", "retard", "scum", "stupid", "trash", "ugly", "vermin", "worthless"),
    "de": ("abschaum", "arschloch", "blödmann", "depp", "dreckig", "dumm", "dummkopf", "ekelhaft", "hässlich", "hurensohn", "idiotin", "lächerlich", "miststück", "scheiße", "schlampe", "schwein", "trottel", "versager", "vollidiot", "wertlos", "widerlich"),
    "fr": ("abruti", "bouffon", "connard", "connasse", "crétin", "dégoûtant", "débile", "imbécile", "merde", "minable", "nul", "ordure", "pourri", "pourriture", "racaille", "salaud", "salope", "stupide"),
    "es": ("asqueroso", "basura", "bastardo", "cabrón", "cerdo", "cretino", "escoria", "estúpido", "feo", "gilipollas", "idiota", "imbécil", "inútil", "mierda", "patético", "perdedor", "puta", "tonto"),
}
LEXICON = tuple(dict.fromkeys(w for words_ in LEXICONS.values() for w in words_))
ADDRESS = ("you", "your", "youre", "ur", "du", "dich", "dein", "deine", "ihr", "euch", "tu", "toi", "ton", "vous", "votre", "tú", "ti", "eres", "usted", "ustedes")
THREATS = ("kill you", "hate you", "hurt you", "shut up", "halt maul", "hasse dich", "hasse euch", "ta gueule", "te déteste", "te odio", "cállate ya")
#: How letters are disguised.
TRICKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
PATTERNS = ("?trick", "?address", "?shout", "?marks", "?threat", "?several")
#: Words between an insult and what makes it worse.
NEAR = 3
#: Lengths of the stems (patterns "stem*") that are proposed as voters beside whole words, and how often a voter may have to find its term.
STEMS, TIMES = (3, 4, 5, 6, 7, 8, 9), (1, 2, 3)
#: Voters proposed from labels at most; the chance at which an excess counts, over all candidates.
MAX_VOTERS, CHANCE = 512, 0.01
#: So many times more are looked at; a stem is left out for a longer term in this share of its rows or more.
NESTED, SAME = 4, 0.9
#: Terms that a task counts before it passes their sums on.
TERMS = 150_000
#: Share of toxic rows, at least, among those in which a proposed voter fires.
PRECISION = 0.6
CACHE = 100_000
#: Finds of a voter in a text that count at most, in training and in scoring.
MOST = 65_535
_lexicon, _address, _threats = frozenset(LEXICON), frozenset(ADDRESS), frozenset(THREATS)
_threat_words = frozenset(t.split()[0] for t in THREATS)
_marks, _signed, _stretched = re.compile(r"[!?]{3,}").findall, re.compile(r"\w*[@$][\w@$]*").findall, re.compile(r"(\w)\1{2,}")


def disguised(word: str) -> bool:
    """Whether a word is an insult only once disguised letters are put right, or letters that stand three times and more are put once."""
    return word not in _lexicon and (word.translate(TRICKS) in _lexicon or _stretched.sub(r"\1", word) in _lexicon)


def beside(text: str, low: list[str]) -> dict[str, int]:
    """Of a text with insults and its words in lower case: address and shout count insults with a word of address, or with a word in
    capitals, within NEAR words; several, different insults beyond the first."""
    at, raw = [i for i, w in enumerate(low) if w in _lexicon], words(text)
    out = {"?address": sum(not _address.isdisjoint(low[max(0, i - NEAR) : i + NEAR + 1]) for i in at), "?several": len({low[i] for i in at}) - 1}
    if len(raw) == len(low):
        out["?shout"] = sum(any(len(w) > 2 and w.isupper() for w in raw[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    return out


def terms(word: str) -> list[str]:
    """A word, and its stems as patterns."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def tally(text: str) -> Iterator[str]:
    """Each term with each of TIMES that it reaches, as "2 term"."""
    found: Counter[str] = Counter()
    for w, n in Counter(words(text.lower())).items():
        for t in terms(w):
            found[t] += n
    for t, n in found.items():
        for k in TIMES:
            if n >= k:
                yield f"{k} {t}"


def propose(rows: DataFrame) -> list[str]:
    """Voters (a number of times and a term) in clear excess among the toxic rows of a sample (text, y), the clearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def sums() -> pa.RecordBatch:
            names = list({**seen[0], **seen[1]})
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([seen[y][x] for x in names], pa.int64()) for y in (1, 0)]], names=["term", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return out

        for b in batches:
            for t, y in zip(texts(b.column(0)), b.column(1), strict=True):
                seen[y.as_py()].update(tally(t))
                if len(seen[0]) + len(seen[1]) > TERMS:
                    yield sums()
        yield sums()

    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return []
    # the log-likelihood ratio of the term's share in either class against one share for both
    a, c = F.col("toxic"), F.col("clean")
    share = (a + c) / F.lit(n1 + n0)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0)
    sums = rows.transform(mapped, run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    tried = sums.where(a >= 2)
    clear = tried.where((a >= PRECISION * (a + c)) & (a + c < n1 + n0)).withColumn("g", 2 * (part(a, F.lit(n1)) + part(c, F.lit(n0))))
    n = max(tried.count(), 1)
    least = 2 * np.log(n / CHANCE)  # the ratio's tail is about exp(-g / 2)
    top = clear.where(F.col("g") > float(least)).orderBy(F.desc("g"), F.length("term"), "term").limit(NESTED * MAX_VOTERS).collect()
    return sharpest({r["term"]: r["toxic"] + r["clean"] for r in top})[:MAX_VOTERS]


def sharpest(found: dict[str, int]) -> list[str]:
    """Voters without those whose stem hardly finds more than a longer stem or a word that begins with it."""
    split = {name: tuple(name.split(" ", 1)) for name in found}
    longest = sorted(found, key=lambda x: (-len(split[x][1].rstrip("*")), split[x][1].endswith("*"), x))
    kept: list[str] = []
    for name in longest:
        times, term = split[name]
        stem = term[:-1] if term.endswith("*") else None
        if stem is None or not any(split[o][0] == times and split[o][1].startswith(stem) and found[o] >= SAME * found[name] for o in kept):
            kept.append(name)
    return [name for name in found if name in set(kept)]


class Voters:
    """How often each voter finds its term or pattern, by one lookup a word; the lookups of words are cached, in bounded memory."""

    def __init__(self, names: list[str]):
        split = [x.split(" ", 1) for x in names]
        self.index = {t: i for i, t in enumerate(dict.fromkeys([*(t for _, t in split), *PATTERNS, "!insult", "!threat"]))}  # the last two only tell where to look
        self.term = np.array([self.index[t] for _, t in split], np.int64)
        self.times = np.array([int(k) for k, _ in split], np.int32)
        self.insult, self.threat = len(self.index) - 2, len(self.index) - 1
        outer = self

        class Hits(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= CACHE:
                    self.clear()
                found = [outer.index[t] for t in terms(word) if t in outer.index]
                found += [outer.index["?trick"]] * disguised(word) + [outer.insult] * (word in _lexicon) + [outer.threat] * (word in _threat_words)
                self[word] = tuple(found)
                return self[word]

        self.hits = Hits()

    def count(self, text: str) -> tuple[np.ndarray, int]:
        """(what each voter finds from the number of times on that it asks for, at most MOST, number of words)."""
        lower = text.lower()
        w = words(lower)
        out = np.zeros(len(self.index), np.int32)
        for found in filter(None, map(self.hits.__getitem__, w)):
            for i in found:
                out[i] += 1
        if "@" in text or "$" in text:
            out[self.index["?trick"]] += sum(disguised(x) for x in _signed(lower))
        if "!!" in text or "??" in text or "!?" in text or "?!" in text:
            out[self.index["?marks"]] = len(_marks(text))
        if out[self.threat]:
            out[self.index["?threat"]] = sum(f"{a} {b}" in _threats for a, b in pairwise(w))
        if out[self.insult]:
            for p, n in beside(text, w).items():
                out[self.index[p]] = n
        return np.clip(out[self.term] - self.times + 1, 0, MOST), len(w)


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, weight of each voter of votes).

    votes: rows by voters, 0 or 1. The label y is two more voters, one for each value, and that no voter fires is another; none has a head
    start. A voter's two firing rates are its accuracy, whether it fires or not; its weight is the inverse of the sum of its correlations,
    within the classes, with those that read the text as it does, so that a crowd that always fires together counts about once. At
    the start a row is as likely toxic as it has votes for that: half with one, two thirds with two.
    """
    v = np.column_stack([votes, ~votes.any(axis=1), y == 1, y == 0]).astype(np.float32)  # zeros and ones: their products are exact
    n, m = v.shape
    both = (v.T @ v).astype(np.float64)
    reads = np.arange(m) < m - 3
    fired = votes.sum(axis=1) + (y == 1).astype(np.float64)
    post = fired / (fired + 1)
    weight = np.ones(m)
    for _ in range(rounds):
        p1, p0 = post.sum(), (1 - post).sum()
        in1, in0 = (x.astype(np.float32) @ v for x in (post, 1 - post))
        t1, t0 = (in1.astype(np.float64) + 0.1) / (p1 + 1), (in0.astype(np.float64) + 0.1) / (p0 + 1)
        # the covariance of what a voter fires beyond its rates, from sums alone
        mixed = np.outer(in1, t1) + np.outer(in0, t0)
        cross = (post * (1 - post)).sum() * np.outer(t1, t0)
        cov = (both - mixed - mixed.T + (post**2).sum() * np.outer(t1, t1) + cross + cross.T + ((1 - post) ** 2).sum() * np.outer(t0, t0)) / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        corr[corr < 0.2] = 0
        weight = np.where(reads, 1 / np.maximum(corr[:, reads].sum(axis=1), 1), 1.0)
        fire, rest = weight * np.log(t1 / t0), np.where(reads, weight * np.log((1 - t1) / (1 - t0)), 0)
        raw = np.log((p1 + 1) / (p0 + 1)) + (v @ (fire - rest).astype(np.float32)).astype(np.float64) + rest.sum()
        new = sigmoid(raw)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, weight[:-3]


@dataclass
class Model:
    """Voters and the classifier's weights; at most those that stand without labels and MAX_VOTERS more."""

    names: list[str]
    share: np.ndarray  # of the label model: how much each voter counts beside those correlated with it
    w: np.ndarray

    @staticmethod
    def inputs(counts: np.ndarray, n_words: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Per row: 1, how many voters fire, how often, and how often a word, each by the voters' shares; whether none fires; and which fire."""
        fired = (counts > 0) * share
        hits = counts @ share
        return np.column_stack([np.ones(len(counts)), np.log1p(fired.sum(axis=1)), np.log1p(hits), np.sqrt(hits / np.maximum(n_words, 1)), counts.sum(axis=1) == 0, 0.3 * fired])

    def score(self, counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(counts, n_words, self.share) @ self.w)


def fit(names: list[str], counts: np.ndarray, n_words: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> Model:
    """Label model, then logistic regression on its posteriors by Newton's method. Without rows of both labels, the share of toxic rows is every score."""
    m = Model(names, np.ones(len(names)), np.zeros(5 + len(names)))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.1) / (len(y) + 1)
        m.w[0] = np.log(share / (1 - share))
        return m
    target, m.share = label_model(counts > 0, y)
    penalty = np.full(len(m.w), ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        curve, slope = np.diag(penalty), -penalty * m.w
        for k in range(0, len(y), 1_000):  # the inputs of a thousand rows at a time
            x = m.inputs(counts[k : k + 1_000], n_words[k : k + 1_000], m.share)
            p = sigmoid(x @ m.w)
            curve += (x * (p * (1 - p))[:, None]).T @ x
            slope += x.T @ (target[k : k + 1_000] - p)
        step = np.linalg.solve(curve, slope)
        m.w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return m


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most max_rows labelled rows, see training.sample. What reaches the driver of each is a count for each voter."""
    rows = sample(docs, labels, label, usable, text_col=text_col, max_rows=max_rows)
    names = list(dict.fromkeys([*[f"1 {w}" for w in (*LEXICON, *PATTERNS)], *propose(rows)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(names)
        for b in batches:
            made = [voters.count(t) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([c.astype("<u2").tobytes() for c, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64()), b.column(1)], names=["counts", "n", "y"])

    got = sorted((y, n, c) for c, n, y in rows.select("text", "y").transform(mapped, run, "counts binary, n long, y int").toArrow().to_pandas().itertuples(index=False))
    counts = np.array([np.frombuffer(c, "<u2") for _, _, c in got]).reshape(len(got), len(names))
    return fit(names, counts, np.array([n for _, n, _ in got], float), np.array([y for y, _, _ in got], np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 if score >= threshold). Null texts score as empty ones; columns of these names
    are replaced; repeated rows are scored alike. One map; the broadcast is bounded by the number of voters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        voters = Voters(m.names)
        for b in batches:
            made = [voters.count(t) for t in texts(b.column(b.schema.names.index(text_col)))]
            out = [m.score(np.array([c for c, _ in made[k : k + 256]]), np.array([n for _, n in made[k : k + 256]], float)) for k in range(0, len(made), 256)]
            yield extended(b, {"score": pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())})

    out = docs.transform(mapped, run, with_fields(docs, [T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
