"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent ones, worker caches for the rest.

A text is cut at every single space between two characters that are not white space. No
pre-token of a byte-level tokenizer spans such a cut, so a text's count is the sum of the counts
of its pieces, each taken with its leading space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.bpe import read_spec
from larder.llm.common import extended, mapped, texts, with_fields, without

#: Entries of a worker's cache, and characters of what either tier holds.
CACHE, CACHED_CHARS = 400_000, 48

#: Python's white space holds all of the tokenizer's, so this can only leave a text uncut where it might be cut.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z").search
CUT = re.compile(r"(?<=\S) (?=\S)").split


def pieces(text: str) -> list[str]:
    """The first piece as it is; the others stand for themselves after one space."""
    return CUT(text) if UNEVEN(text) else text.split(" ")


@lru_cache(maxsize=2)
def library(spec: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


class Counts(dict):
    """The second tier: what a worker has encoded, emptied when full. The first tier is asked before."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def learn(self, missing: list[str]) -> None:
        for p, e in zip(missing, self.tokenizer.encode_batch([" " + p for p in missing], add_special_tokens=False), strict=True):
            self[p] = len(e.ids)

    def total(self, text: str, frequent: dict[str, int]) -> int:
        if not text:
            return 0
        first, *rest = pieces(text)
        n = len(self.tokenizer.encode(first, add_special_tokens=False).ids)
        hits = list(map(frequent.get, rest))
        if None not in hits:
            return n + sum(hits)
        cold = [p for p, k in zip(rest, hits, strict=True) if k is None]
        if len(self) > CACHE:
            self.clear()
        missing = list({p for p in cold if p not in self})
        if missing:
            self.learn(missing)
        n += sum(k for k in hits if k is not None) + sum(map(self.__getitem__, cold))
        for p in missing:
            if len(p) > CACHED_CHARS:
                del self[p]
        return n


@lru_cache(maxsize=1)
def cache(spec: str) -> Counts:
    """A worker's second tier, which lasts over its tasks."""
    return Counts(library(spec))


def frequent_lengths(tokenizer) -> dict[str, int]:
    """Number of tokens of the pieces that the vocabulary itself has after a space: a byte-pair vocabulary is made of what is frequent, so no
    pass over the corpus and no shuffle is needed to find it. It decides which lookups are fast, not what any of them returns."""
    every = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False)
    held = sorted({x[1:] for x in every if x[:1] == " " and 1 < len(x) <= CACHED_CHARS and not any(c.isspace() for c in x[1:])})
    return {p: len(e.ids) for p, e in zip(held, tokenizer.encode_batch([" " + p for p in held], add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with `n_bytes` (of UTF-8), `n_tokens` (long) and `over_limit` (n_tokens > limit).

    Counts equal those of the tokenizers library without added special tokens, truncation or
    padding; special strings inside texts count as its default has them. Null and empty texts
    count zero. Input columns of the new names are replaced; rows with a null id stay. One map over
    the input; the broadcast holds no more pieces than the vocabulary has tokens, each of at most CACHED_CHARS characters.
    """
    sc = docs.sparkSession.sparkContext
    text = read_spec(tokenizer_path)
    tokenizer = library(text)
    spec, frequent = sc.broadcast(text), sc.broadcast(frequent_lengths(tokenizer))
    new = T.StructField("n_tokens", T.LongType())
    docs = without(docs, ["n_bytes", "n_tokens", "over_limit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = cache(spec.value), frequent.value
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            yield extended(batch, {"n_tokens": pa.array([counts.total(t, hot) for t in texts(column)], pa.int64())})

    out = docs.transform(mapped, run, with_fields(docs, [new]))
    return out.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
