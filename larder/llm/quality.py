"""Quality by a factorisation machine over hashed words, the text's structure and its metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is taken in
time linear in the features as half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import extended, mapped, texts, with_fields, without
from larder.llm.training import MAX_ROWS, sample, sigmoid, words

#: Buckets of hashed words, rank of the interactions, bins of each statistic.
BUCKETS, RANK, BINS = 1 << 14, 8, 12
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.08, 2e-5
CACHE = 400_000

STATISTICS = ("length", "words", "word_length", "distinct", "repeated_next", "commonest", "lines", "repeated_lines", "upper", "digits", "marks", "doubled_marks", "inner_marks", "bars", "spaces", "short_lines", "stated_length", "stated")
DOUBLED = re.compile(r"([^\w\s])\1").findall
MARKS = re.compile(r"[^\w\s]").findall
DIGITS = re.compile(r"\d").findall
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall


def statistics(text: str, stated: int | None, w: list[str], ids: np.ndarray) -> list[float]:
    """Numbers about the form of a text; stated is the length its metadata give."""
    n, k = max(len(text), 1), max(len(w), 1)
    lines = text.split("\n")
    chunks = text.split()
    counts = np.unique(ids, return_counts=True)[1] if len(ids) else np.ones(1, int)
    marks, doubled = len(MARKS(text)), len(DOUBLED(text))
    return [
        np.log1p(len(text)), np.log1p(len(w)), sum(map(len, w)) / k, len(counts) / k**0.8, float((ids[1:] == ids[:-1]).sum()) / k, counts.max() / k,
        len(lines) / k, 1 - len(set(lines)) / len(lines), len(UPPER(text)) / n, len(DIGITS(text)) / n, marks / n, doubled / k,
        sum(not c[-1:].isalnum() for c in chunks) / max(len(chunks), 1), text.count("|") / k, (n - sum(map(len, chunks))) / n, sum(len(x) < 20 for x in lines) / len(lines),
        np.log1p(len(text)) - np.log1p(max(stated, 0)) if stated is not None else 0.0, float(stated is not None),
    ]


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bucket = self[word] = xxhash.xxh32_intdigest(word.encode()) % BUCKETS
        return bucket


def features(text: str, stated: int | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets of the words, statistics)."""
    w = words(text.lower())
    ids = np.fromiter(map(buckets.__getitem__, w), np.int32, len(w))
    return np.unique(ids), np.array(statistics(text, stated, w, ids), np.float32)


@dataclass
class Machine:
    """Weights of a factorisation machine; edges are the statistics' bin bounds. Its size is fixed by BUCKETS, RANK and BINS."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return (self.edges < stats[..., None]).sum(axis=-1) + np.arange(len(STATISTICS)) * (BINS + 1) + BUCKETS

    def inputs(self, ids: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: words share a norm of one, a statistic has its bin."""
        return self.binned(ids, self.bins(stats))

    @staticmethod
    def binned(ids: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([ids, bins]), np.concatenate([np.full(len(ids), 1 / max(len(ids), 1) ** 0.5, np.float32), np.full(len(bins), 0.5, np.float32)])

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[index] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[index] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> Machine:
    """A machine by AdaGrad on the logistic loss. Without rows of both labels it scores the share of ones (0.5 for none).

    Below 4,000 rows there are more epochs, up to eight times, so that there are as many steps. The rows' words stay as they came (two bytes each
    from _featured); inputs are made for a batch at a time.
    """
    rng = np.random.default_rng(seed)
    n_stats, size = len(STATISTICS), BUCKETS + len(STATISTICS) * (BINS + 1)
    y = np.array([r[2] for r in rows], np.float32)
    stats = np.array([r[1] for r in rows], np.float32).reshape(-1, n_stats)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T if len(rows) else np.zeros((n_stats, BINS))
    share = float((y.sum() + 0.5) / (len(y) + 1))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), edges.astype(np.float32))
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        return m
    bins = m.bins(stats).astype(np.int32)
    gw, gv, g0 = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32), 1e-3
    epochs = EPOCHS * max(1, min(8, 4_000 // len(rows)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            data = [m.binned(rows[i][0], bins[i]) for i in part.tolist()]
            index = np.concatenate([a for a, _ in data])
            x = np.concatenate([b for _, b in data])
            starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in data])[:-1]])
            lengths = np.diff(np.append(starts, len(index)))
            vx = m.v[index] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            raw = m.w0 + np.add.reduceat(m.w[index] * x, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            slope = np.repeat((sigmoid(raw) - y[part]) / len(part), lengths)
            dw = slope * x
            dv = dw[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            order_ = np.argsort(index, kind="stable")
            touched, first = np.unique(index[order_], return_index=True)
            gw_ = np.add.reduceat(dw[order_], first) + DECAY * m.w[touched]
            gv_ = np.add.reduceat(dv[order_], first, axis=0) + DECAY * m.v[touched]
            gw[touched] += gw_**2
            gv[touched] += gv_**2
            m.w[touched] -= RATE * gw_ / np.sqrt(gw[touched])
            m.v[touched] -= RATE * 0.5 * gv_ / np.sqrt(gv[touched])
            g = float((sigmoid(raw) - y[part]).mean())
            g0 += g * g
            m.w0 -= RATE * g / g0**0.5
    return m


def _featured(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of the sample's rows (text, y, stated), on the driver: at most MAX_ROWS rows of at most BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for b in batches:
            made = [features(t, s.as_py(), buckets) for t, s in zip(texts(b.column(0)), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype("<u2").tobytes() for i, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary()), b.column(1)], names=["ids", "stats", "y"])

    got = rows.transform(mapped, run, "ids binary, stats binary, y int").orderBy(F.xxhash64("ids", "stats"), "y").toArrow()
    return [(np.frombuffer(i.as_buffer(), "<u2"), np.frombuffer(s.as_py(), np.float32), y.as_py()) for i, s, y in zip(*got.columns, strict=True)]


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text_col: str = "text", stated_col: str | None = "n_chars", max_rows: int = MAX_ROWS) -> Machine:
    """Fits on at most max_rows labelled rows, see training.sample."""
    return fit(_featured(sample(docs, labels, label, usable, text_col=text_col, max_rows=max_rows, stated_col=stated_col)))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", stated_col: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 if score >= threshold). Null texts score as empty ones; a null stated length is its own
    value. Columns of these names are replaced; repeated rows are scored alike. One map; the broadcast has a fixed size."""
    weights = docs.sparkSession.sparkContext.broadcast(machine)
    docs = without(docs, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, buckets = weights.value, _Buckets()
        for b in batches:
            column = b.column(b.schema.names.index(text_col))
            stated = b.column(b.schema.names.index(stated_col)) if stated_col else [None] * len(column)
            out = [m.raw(*m.inputs(*features(t, s.as_py() if s is not None else None, buckets))) for t, s in zip(texts(column), stated, strict=True)]
            yield extended(b, {"score": pa.array(sigmoid(np.array(out, np.float64)), pa.float64())})

    out = docs.transform(mapped, run, with_fields(docs, [T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
