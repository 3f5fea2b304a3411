"""Mixing sources to target weights by hash thresholds.

Every document has a hash; a source's mix takes each document a whole number of times and, once
more, those whose hash lies below a threshold. Thresholds come from nested histograms: words
summed by source and hash bucket give the bucket in which the running total passes the budget, and
only that bucket is divided again, until it is a single hash. Nothing is sorted by document, and
the final choice is a filter that any row can be put to by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm.common import checkpoint
from larder.operators.ranges import numbered, running

#: Hashes have HASH_BITS bits; each histogram divides a bucket by 2 ** STEP_BITS.
HASH_BITS, STEP_BITS = 60, 12
#: The table of sources is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 50_000

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(key: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the key as text, a slash and the text (nulls: empty strings)."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass
class Mix:
    """`sources` has for each source its size, target, how often all of it is taken, and the last hash that is taken once more, wholly or up to it."""

    sources: DataFrame
    slim: DataFrame  # key, source, size and hash of every row, checkpointed
    n_sources: int

    def times(self, rows: DataFrame, source: Column, key_hash: Column) -> DataFrame:
        """rows with source_size, target and times (how often the mix takes the row)."""
        side = self.sources.select(F.col("_source").alias("_mixed"), "source_size", "target", "_whole", "_last", "_with_last")
        side = F.broadcast(side) if self.n_sources <= BROADCAST_SOURCES else side
        joined = rows.withColumns({"_s": source, "_k": key_hash}).join(side, F.col("_s").eqNullSafe(F.col("_mixed")), "left")
        more = (F.col("_k") < F.col("_last")) | ((F.col("_k") == F.col("_last")) & F.col("_with_last"))
        return joined.withColumn("times", F.col("_whole") + F.coalesce(more, F.lit(False)).cast("int")).drop("_s", "_k", "_mixed", "_whole", "_last", "_with_last")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Targets by weight, filled like connected vessels: the sources whose limit is lowest for their weight are full first.

    sizes: _source, source_size. share: the budget as a fraction of all sizes. However many sources there are, they are numbered and summed by ranges.
    """
    p, q = share
    rows = numbered(sizes.withColumn("_void", F.col("_source").isNull()), "_void", "_source", name="_n")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("long")
    rows = rows.withColumns({"_w": weight, "_cap": F.col("source_size") * most}).withColumn("_fill", F.col("_cap") / F.col("_w"))
    rows = running(rows, ["_fill", "_n"], {"_given": "_cap", "_served": "_w"})
    size, weights_ = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    rows = rows.withColumns({"_left": F.lit(size * p).cast("long") - F.col("_given") * q, "_weights": F.lit(weights_).cast("long") - F.col("_served")})  # _left: budget not yet given out, times q
    full = F.col("_cap") * q * F.col("_weights") <= F.col("_w") * F.col("_left")
    rows = checkpoint(rows.withColumn("_full", full).select("_source", "source_size", "_cap", "_w", "_fill", "_n", "_left", "_weights", "_full"))
    level = rows.where(~F.col("_full")).agg(F.min_by(F.struct("_left", "_weights"), F.struct("_fill", "_n")).alias("at")).first()["at"]
    left, shared = (level["_left"], level["_weights"]) if level else (0, 1)  # without a level all are full
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w").cast("double") * F.lit(left).cast("long") / F.lit(shared * q).cast("long"))
    return rows.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, text: str = "text") -> Mix:
    """How often each row of docs is taken.

    Sources, by code point and null last, weigh `weights`, repeating, and share p/q of all sizes; a target stops
    at `most` times its source's size, the rest being shared again by weight. A source's taken size differs from its target by at
    most half of one hash's rows. Hashes are of key and text, so rows that share a key, or have none, part by their
    texts; rows equal in both are taken alike. Null texts have size 0; an empty table gives an empty mix. Reruns agree. The sizes are
    read once; what is kept of a row for the histograms is its key, source, size and hash.
    """
    size = words(F.col(text)) if size is None else size
    slim = checkpoint(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("size"), hashed(F.col(key), F.col(text)).alias("_h")))
    sizes = slim.groupBy("_source").agg(F.sum("size").alias("source_size"))
    rows = targets(sizes, weights, share, most).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    state = checkpoint(rows.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    n_sources = state.count()
    small = lambda df: F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df

    inside = slim.where("size > 0").select("_source", "size", "_h")
    bounds = state.select("_source", "_rest", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_below"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if shift + STEP_BITS < HASH_BITS:  # only rows of the bucket that the last histogram ended in
            near = small(bounds.select(F.col("_source").alias("_b"), F.col("_at")))
            inside = inside.join(near, F.col("_source").eqNullSafe(F.col("_b")) & (F.shiftright("_h", shift + STEP_BITS) == F.col("_at"))).select("_source", "size", "_h")
            if shift + 2 * STEP_BITS == HASH_BITS:
                inside = checkpoint(inside)
        sums = inside.groupBy("_source", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_n"))
        passed = F.sum("_n").over(W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        side = small(bounds.select(F.col("_source").alias("_b"), "_rest", "_below"))
        over = sums.withColumn("_to", passed).join(side, F.col("_source").eqNullSafe(F.col("_b"))).where(F.col("_below") + F.col("_to") > F.col("_rest"))
        bounds = over.groupBy("_source").agg(F.min_by(F.struct("_rest", F.col("_bucket").alias("_at"), (F.col("_below") + F.col("_to") - F.col("_n")).alias("_below"), "_n"), "_bucket").alias("x")).select("_source", "x.*")
        bounds = checkpoint(bounds)  # a row a source; the next level reads it three times
    nearer = F.col("_below") + F.col("_n") - F.col("_rest") < F.col("_rest") - F.col("_below")
    last = bounds.select(F.col("_source").alias("_b"), F.col("_at").alias("_last"), nearer.alias("_with_last"))
    # a source without a bound has nothing left to take beyond its whole times
    sources = state.join(last, F.col("_source").eqNullSafe(F.col("_b")), "left").drop("_b")
    return Mix(checkpoint(sources), slim, n_sources)


def taken(m: Mix, key: str = "doc_id") -> DataFrame:
    """One row per document: key, size, source_size, target, taken (times of size)."""
    out = m.times(m.slim, F.col("_source"), F.col("_h"))
    return out.select(F.col("_key").alias(key), "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def apply(m: Mix, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs as the mix takes them: rows taken twice occur twice, others once or not at all. Columns stay as they were."""
    kept = m.times(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")), F.col(f"_row.`{source}`"), hashed(F.col(f"_row.`{key}`"), F.col(f"_row.`{text}`")))
    return kept.where("times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_i")).select("_row.*")


#: The same in DuckDB: documents in the order of their hashes, with running totals.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap FROM n),
f AS (SELECT *, sum(source_size) OVER () * 3 - (sum(cap) OVER o - cap) * 2 AS left_, sum(w) OVER () - (sum(w) OVER o - w) AS weights
      FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, cap * 2 * weights <= w * left_ AS is_full FROM f),
lv AS (SELECT left_, weights FROM g WHERE NOT is_full ORDER BY cap / w, n LIMIT 1),
t AS (SELECT g.source, g.source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(g.w AS DOUBLE) * CAST(lv.left_ AS DOUBLE) / CAST(lv.weights * 2 AS DOUBLE) END AS target FROM g LEFT JOIN lv ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM e),
hs AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
b AS (SELECT r.source, min(hs.h) AS last_h, min_by(2 * (hs.upto - r.rest) < hs.n, hs.h) AS with_last
      FROM r JOIN hs ON r.source IS NOT DISTINCT FROM hs.source WHERE hs.upto > r.rest AND hs.n > 0 GROUP BY r.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (r.whole + CASE WHEN d.h < b.last_h OR (d.h = b.last_h AND b.with_last) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM r.source
"""
