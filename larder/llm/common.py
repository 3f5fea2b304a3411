"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larder.operators.lineage import checkpoint, discard, ensure_checkpoint_dir, scratch

__all__ = ["checkpoint", "discard", "ensure_checkpoint_dir", "extended", "mapped", "scratch", "sliced", "spread", "texts", "whole_runs", "with_fields", "without"]

#: Rows and bytes of an Arrow batch that a Python operator hands back to the JVM.
OUT_ROWS, OUT_BYTES = 2_000, 8 << 20
#: Bytes of a batch that the JVM hands to a Python operator: texts are long, and both sides hold a batch or two of each task.
IN_BYTES, BATCH_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tasks that rows are spread over at most; beyond it they get more each, which pass by.
MOST_TASKS = 20_000


def share_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once a SparkContext, so that their Python workers can import it wherever they run. The driver serves the file."""
    sc = spark.sparkContext
    if getattr(sc, "_larder_shared", None) is None:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="larder-code-")) / "larder.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package).as_posix()}")
        sc.addPyFile(str(archive))
        sc._larder_shared = True


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), on workers that have this package, in batches of IN_BYTES at most (a session that has a lower limit keeps it)."""
    spark = df.sparkSession
    share_code(spark)
    limit = int(spark.conf.get(BATCH_BYTES).rstrip("b"))
    if limit > IN_BYTES:
        spark.conf.set(BATCH_BYTES, IN_BYTES)
    return df.mapInArrow(tidied(run), schema)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives what the task has freed back to the system: workers stay, and other operators' tasks run beside them."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a system without glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy


def spread(df: DataFrame, column: str, each: int) -> DataFrame:
    """df (written already, as its rows are counted) dealt by a column to tasks of some `each` rows, before an operator that makes many rows of one."""
    return df.repartition(min(max(1, -(-df.count() // each)), MOST_TASKS), column)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns that an operator is about to add; names compare without case, as Spark's do."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def with_fields(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def sliced(rows: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows under OUT_ROWS and OUT_BYTES; rows are (index, bytes) in order."""
    start, total, last = None, 0, -1
    for i, n in rows:
        if start is None:
            start, total = i, 0
        elif i - start >= OUT_ROWS or total + n > OUT_BYTES:
            yield start, i
            start, total = i, 0
        total, last = total + n, i
    if start is not None:
        yield start, last + 1


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The strings of a column one at a time, null as the empty string."""
    for x in column:
        yield x.as_py() or ""


def extended(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with more columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def whole_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of sorted rows as arrays, cut between runs that agree in the first n_keys columns; the last run of a batch is held until it ends."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(now[0]):
            continue
        if held and all(held[0][i][0] == now[i][-1] for i in range(n_keys)):
            held.append(now)
            continue
        now = tuple(np.concatenate(x) for x in zip(*held, now, strict=True))
        other = np.zeros(len(now[0]), bool)
        for i in range(n_keys):
            other |= now[i] != now[i][-1]
        cut = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
        if cut:
            yield tuple(x[:cut] for x in now)
        held = [tuple(x[cut:] for x in now)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
