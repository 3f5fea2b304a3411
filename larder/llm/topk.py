"""Exact top-k inner-product search by MaxScore over shards of postings.

A dimension is a term and a component its impact. A shard holds, for each dimension, the components of
its vectors and their extremes. For a query, a term's bound is the most that it can add in the
shard. Terms are taken by descending bound; the leading ones are essential as long as what the
rest can add still reaches the query's k-th best score. Essential postings are traversed for all of a
shard; the others are probed only for vectors that remain competitive. What shards keep is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, mapped

#: Vectors of a shard, queries of a block, pairs of a shard and a block that one task gets, non-essential terms probed between two looks at what is competitive.
SHARD, BLOCK, CELL, STEP = 4_096, 256, 16, 8
#: Sums of products below this are exact in double precision.
EXACT = 2**53


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double; null if the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long")))


def _packed(rows: DataFrame, size: int, n: int) -> DataFrame:
    """rows (id, q) as blocks of at most size: ids and components (dimension by dimension) as bytes. Shorter vectors are filled with zeros."""

    def block(ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        m = np.zeros((max(map(len, vectors)), len(ids)), "<i8")
        for j, v in enumerate(vectors):
            m[: len(v), j] = v
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["ids", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield block(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield block(ids, vectors)

    return checkpoint(rows.repartition(max(1, -(-n // size))).transform(mapped, run, "ids binary, m binary"))


class Best:
    """The k best (score, smaller id first) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores: list[list[int]] = [[] for _ in ids]
        self.found: list[list[int]] = [[] for _ in ids]

    def floor(self, i: int) -> int | None:
        return self.scores[i][-1] if len(self.scores[i]) == self.k else None

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[i]
        scores, ids = scores[other], ids[other]
        if len(scores) > 4 * self.k:  # all that tie with the k-th stay for the order by id
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        both = sorted([*zip((-s for s in self.scores[i]), self.found[i], strict=True), *zip((-int(s) for s in scores), ids.tolist(), strict=True)])[: self.k]
        self.scores[i], self.found[i] = [-s for s, _ in both], [x for _, x in both]


def search(best: Best, queries: np.ndarray, ids: np.ndarray, postings: np.ndarray) -> None:
    """Queries (rows by dimensions) against one shard (dimensions by vectors)."""
    dims = min(queries.shape[1], postings.shape[0])  # a dimension that either side lacks adds nothing
    queries, postings = queries[:, :dims], postings[:dims]
    if not dims or not len(ids):
        for i in range(len(queries)):
            best.add(i, np.zeros(len(ids), np.int64), ids)
        return
    low, high = postings.min(axis=1), postings.max(axis=1)
    most = float(np.abs(queries.astype(float)).max()) * float(max(abs(float(low.min())), abs(float(high.max())))) * dims
    kind = np.float64 if most < EXACT else object
    q, p, low, high = (x.astype(kind) for x in (queries, postings, low, high))
    for i in range(len(q)):
        bound = np.maximum(q[i] * low, q[i] * high)
        order = np.argsort(-bound.astype(float), kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, kind)])  # what the terms from here on can add
        floor = best.floor(i)
        essential = dims if floor is None else int(np.argmax(rest < floor)) if (rest < floor).any() else dims
        lead = order[:essential]
        total = q[i, lead] @ p[lead] if essential else np.zeros(p.shape[1], kind)
        alive = np.arange(p.shape[1])
        at = essential
        while at < dims and len(alive):
            keep = total + rest[at] >= floor
            alive, total = alive[keep], total[keep]
            some = order[at : at + STEP]
            total = total + q[i, some] @ p[np.ix_(some, alive)]
            at += STEP
        if floor is not None:
            keep = total >= floor
            alive, total = alive[keep], total[keep]
        if len(alive):
            best.add(i, total.astype(np.int64) if kind is np.float64 else total, ids[alive])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, its k highest inner products with other rows, ties to the smaller id.

    Vectors and keys that are null, and vectors with null or non-finite components, take no part; other columns are not
    carried. Where lengths differ, missing components are zero. Rows repeated under one id are candidates each, but not for a
    query of the same id; repeated queries are answered once, and the vectors of an id that has several as one query, each candidate by its scores with all of them. Fewer candidates than k give fewer rows; an empty table none. A score that
    does not fit 64 bits raises. Every query meets every shard once, in blocks of bounded size; what travels is blocks and, of each task, k rows a query.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("q"), is_query.alias("asks")).where("id IS NOT NULL AND q IS NOT NULL")
    rows = checkpoint(rows)
    asked = rows.where("asks").dropDuplicates(["id", "q"]).select("id", "q")
    n, m = rows.count(), asked.count()
    shards, blocks = _packed(rows.select("id", "q"), SHARD, n), _packed(asked, BLOCK, m)
    c, b = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    cells = max(1, -(-c * b // CELL))
    across = min(c, max(1, round((cells * c / b) ** 0.5)))
    down = min(b, max(1, -(-cells // across)))
    # each shard belongs to a column of the grid and is sent to all its rows, each block the other way round
    shards = shards.select("ids", "m", F.pmod(F.xxhash64("ids"), F.lit(across)).alias("column"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("row"))
    blocks = blocks.select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.pmod(F.xxhash64("ids"), F.lit(down)).alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("column"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        for batch in batches:
            for ids, m_, q_ids, q_m in zip(*(batch.column(j) for j in range(4)), strict=True):
                asked_ids = q_ids.as_py()
                asked_q = q_m.as_py()
                one = best.setdefault(asked_ids + xxhash.xxh3_128_digest(asked_q), Best(np.frombuffer(asked_ids, "<i8"), k))
                queries = np.frombuffer(asked_q, "<i8").reshape(-1, len(one.ids)).T
                own = np.frombuffer(ids.as_py(), "<i8")
                search(one, queries, own, np.frombuffer(m_.as_py(), "<i8").reshape(-1, len(own)))
        for one in best.values():
            flat = [(int(i), x, s) for i, xs, ss in zip(one.ids, one.found, one.scores, strict=True) for x, s in zip(xs, ss, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    kept = shards.join(blocks, ["row", "column"]).select("ids", "m", "q_ids", "q_m").transform(mapped, run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB, query by query against all rows.
ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT list_contains([x IS NOT NULL AND isfinite(x) FOR x IN embedding], false)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
