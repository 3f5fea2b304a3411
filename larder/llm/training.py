"""Bounded samples of labelled documents to fit classifiers on, and the words that classifiers see."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, mapped, texts

#: Labelled rows that a classifier is fitted on at most, those with the smallest hashes of their ids.
MAX_ROWS = 20_000

#: Words as the classifiers see them: runs of letters, digits and underscores, in lower case.
words = re.compile(r"\w+").findall


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null: of the empty string)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def family(text: str) -> int:
    """The smallest hash over runs of five words: equal for most pairs of near copies."""
    w = words(text.lower())
    runs = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    return min(xxhash.xxh64_intdigest(r.encode(), 7) for r in runs) - (1 << 63)


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, stated_col: str | None = None) -> DataFrame:
    """(text, y, stated) of at most max_rows labelled rows that `usable` allows, one of each family of near copies and label; checkpointed.

    Labels other than 0 and 1 don't count; where a key has several, the highest does. The ids are
    chosen before any text is read, so only the sample's texts travel. stated: a document's stated length, from stated_col (null without one).
    """
    picked = labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("_k"), "_k").limit(max_rows)
    rows = docs.select(F.col(key).alias("_d"), F.col(text_col).alias("text"), (F.col(stated_col) if stated_col else F.lit(None)).cast("long").alias("stated")).join(F.broadcast(picked), F.col("_d") == F.col("_k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([family(t) for t in texts(b.column(0))], pa.int64())], names=["text", "y", "stated", "family"])

    first = F.min(F.struct("text", "stated")).alias("x")
    return checkpoint(rows.select("text", "y", "stated").transform(mapped, run, "text string, y int, stated long, family long").groupBy("family", "y").agg(first).select("x.text", "y", "x.stated"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
