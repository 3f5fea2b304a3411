"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a variant in common that lies within two
bits of both, and any two within two bits of one variant differ in at most four. So each
fingerprint emits the variants within half the radius, and fingerprints that share one are linked,
without a check that could fail.

All 2,081 variants need not travel. The 64 bits form three blocks; some block holds at least
a third of the differing bits, so the other two differ in at most two, and each side has to
change at most one bit there. The shuffle is on those parts of the variants (131 a
fingerprint: for each block left out, the rest as it is and with one bit changed); where
fingerprints meet, the block left out is varied in place within what remains of each one's two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import near_copies
from larder.llm.common import checkpoint, extended, mapped, sliced, spread, texts, with_fields, without
from larder.llm.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Runs of up to so many fingerprints under a key are compared in pairs, longer ones by varying the block left out.
PAIRS = 24
#: Fingerprints varied at a time, and variants matched at a time.
PORTION, VARIANTS = 4_096, 1_000_000
#: Fingerprints of a task that emits.
EACH = 25_000


def bits(numbers: list[int]) -> np.ndarray:
    return np.array([1 << n for n in numbers], np.uint64)


def fingerprint(text: str) -> int:
    """64 bits: each set if set in over half the hashes of the shingles of the lower-cased (A to Z) text."""
    words = text.encode().lower().split()  # on bytes: ASCII letters, and white space U+0009 to U+000D and U+0020
    if not words:
        return 0
    joined = b" ".join(words)
    view = memoryview(joined)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(view[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `simhash` (long: the 64 bits). Null and empty texts, and those of white space only, have 0."""
    docs = without(docs, ["simhash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t) for t in texts(batch.column(batch.schema.names.index(text_col)))], np.uint64)
            yield extended(batch, {"simhash": pa.array(out.view(np.int64))})

    return docs.transform(mapped, run, with_fields(docs, [T.StructField("simhash", T.LongType())]))


def rest_of(fps: np.ndarray, block: int) -> np.ndarray:
    """The bits outside a block, moved together."""
    low, high = BLOCKS[block]
    return (fps & np.uint64((1 << low) - 1)) | (fps >> np.uint64(high) << np.uint64(low) if high < 64 else np.uint64(0))


def shuffle_keys(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, 131): the parts of the variants that travel; the top bits tell which block is left out."""
    out = []
    for block, (low, high) in enumerate(BLOCKS):
        flips = np.concatenate([[np.uint64(0)], bits(list(range(64 - (high - low))))])
        out.append((rest_of(fps, block)[:, None] ^ flips[None, :]) | np.uint64(block << 60))
    return np.concatenate(out, axis=1)


def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(every), PORTION):
            fps = every[k : k + PORTION]
            keys = shuffle_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]).view(np.int64))], names=["key", "fp"])


def near_in(fps: np.ndarray, spent: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among many fingerprints under one key: each is varied in the block left out by the bits it has
    not spent on the key. Those that meet are within the radius; of the chains through each meeting, one link a
    fingerprint stays. Variants are made and matched in slices, so memory doesn't follow their number."""
    one = bits(list(range(low, high)))
    two = np.array([a | b for i, a in enumerate(one) for b in one[i + 1 :]], np.uint64)
    none, hole = np.zeros(1, np.uint64), np.uint64(((1 << (high - low)) - 1) << low)
    masks = [np.concatenate([none, one, two]), np.concatenate([none, one])]
    slices = max(1, int(sum(len(masks[s]) * (spent == s).sum() for s in (0, 1))) // VARIANTS)
    label = np.arange(len(fps))
    for turn in range(slices):
        spots, owners = [], []
        for s in (0, 1):
            mine = np.flatnonzero(spent == s)
            for k in range(0, len(mine), PORTION):
                some = mine[k : k + PORTION]
                spot = ((fps[some] & hole)[:, None] ^ masks[s][None, :]).ravel()
                owner = np.repeat(some, len(masks[s]))
                if slices > 1:
                    here = (spot >> np.uint64(low)) % np.uint64(slices) == turn
                    spot, owner = spot[here], owner[here]
                spots.append(spot)
                owners.append(owner)
        spot, owner = np.concatenate(spots), np.concatenate(owners)
        order = np.argsort(spot, kind="stable")
        spot, owner = spot[order], owner[order]
        meet = spot[1:] == spot[:-1]
        a, b = owner[:-1][meet], owner[1:][meet]
        while True:
            low_ = np.minimum(label[a], label[b])
            if (low_ == label[a]).all() and (low_ == label[b]).all():
                break
            np.minimum.at(label, label[a], low_)
            np.minimum.at(label, label[b], low_)
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among (key, fp) rows that come sorted by key. A run that spans batches is held: under one key there
    are distinct fingerprints only, 8 bytes each, whose bits outside one block all lie within one bit of the key."""
    held_k, held_f = [], []
    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        if not len(k):
            continue
        if held_k and held_k[0][0] != k[0] or k[0] != k[-1]:
            k, f = np.concatenate([*held_k, k]), np.concatenate([*held_f, f])
            cut = len(k) - int(np.argmax((k != k[-1])[::-1])) if k[0] != k[-1] else 0
            yield from linked(k[:cut], f[:cut])
            held_k, held_f = [k[cut:]], [f[cut:]]
        else:
            held_k.append(k)
            held_f.append(f)
    if held_k:
        yield from linked(np.concatenate(held_k), np.concatenate(held_f))


def linked(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of whole runs, as (a, b) with a > b."""
    if len(k) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    size_of = np.repeat(sizes, sizes)
    short = (size_of > 1) & (size_of <= PAIRS)
    found = []
    ks, fs = k[short], f[short]
    for lag in range(1, PAIRS):
        same = ks[lag:] == ks[:-lag]
        if not same.any():
            break
        a, b = fs[lag:][same], fs[:-lag][same]
        near = np.bitwise_count(a ^ b) <= RADIUS
        found.append((a[near], b[near]))
    for s, n in zip(starts[sizes > PAIRS].tolist(), sizes[sizes > PAIRS].tolist(), strict=True):
        block, fps = int(k[s] >> np.uint64(60)), f[s : s + n]
        rest = rest_of(fps, block)
        spent = np.bitwise_count(rest ^ (k[s] & np.uint64((1 << 60) - 1)))
        if spent.min() == 0 or (rest != rest[0]).any():  # else they also meet where nothing is spent
            found.append(near_in(fps, spent, *BLOCKS[block]))
    a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1)) if found else (np.empty(0, np.int64),) * 2
    if len(a):
        a, b = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints (one long column): each pair within RADIUS bits is joined, by its own
    link or by a chain of links, and each link joins two that steps within RADIUS lead from one to the other."""
    keyed = spread(fps, fps.columns[0], EACH).transform(mapped, emitted, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").transform(mapped, met, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, simhash, component_id) for every row of docs.

    component_id is the smallest key reachable over fingerprints that differ in at most RADIUS bits, the row's own
    included. Null and empty texts share the fingerprint zero, which links like any other; repeated rows stay and
    share a component; null keys are never a component's id unless it has no other. Other columns are not
    carried. Rows are grouped by fingerprint before anything is linked, so copies cost one row.
    """
    slim = checkpoint(fingerprints(docs.select(docs[key].alias("_key"), docs[text_col].alias("_text")), "_text").select("_key", "simhash"))
    first = checkpoint(slim.groupBy("simhash").agg(F.min("_key").alias("_first")))
    linked_ = components(links(first.select("simhash")))
    placed = checkpoint(first.join(linked_, first["simhash"] == linked_["node"], "left").select("simhash", "_first", F.coalesce("component", "simhash").alias("_c")))
    lowest = checkpoint(placed.groupBy("_c").agg(F.min("_first").alias("component_id")))
    named = checkpoint(placed.join(lowest, "_c").select("simhash", "component_id"))
    return slim.join(named, "simhash").select(F.col("_key").alias(key), "simhash", "component_id")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _row, text) to (doc_id, _row, simhash, sig, keys)."""
    for batch in batches:
        for i, j in sliced((n, len(t)) for n, t in enumerate(texts(batch.column(2)))):
            own = list(texts(batch.column(2).slice(i, j - i)))
            made = [near_copies.sketch(near_copies.shingles(t)) for t in own]
            prints = np.array([fingerprint(t) for t in own], np.uint64).view(np.int64)
            columns = [*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(prints), pa.array([s for _, s in made], pa.binary()), pa.array([k for k, _ in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "simhash", "sig", "keys"])


def survivors(docs: DataFrame) -> DataFrame:
    """(_row) of the rows to keep of docs (doc_id, _row, text): of each component the first by doc_id (null last) and _row.

    Linked are fingerprints that differ in at most RADIUS bits and, since those find few copies with a similarity of 0.8, texts whose
    five-word shingles have that or more (near_copies). Texts with one fingerprint are one node, which has the first one's shingles.
    """
    sketched = mapped(docs.select("doc_id", "_row", "text"), _sketched, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _row string, simhash long, sig binary, keys array<long>")
    order = (F.col("doc_id").isNull().alias("void"), "doc_id", "_row")
    first = checkpoint(sketched.groupBy("simhash").agg(F.min_by(F.struct(*order, "sig", "keys"), F.struct(*order)).alias("at")).select("simhash", "at.*"))
    nodes = first.select(F.col("simhash").alias("node"), "_row", "sig", "keys")
    linked_ = components(links(first.select("simhash")).unionByName(near_copies.links(nodes, docs)))
    placed = first.select("simhash", F.struct("void", "doc_id", "_row").alias("at")).join(linked_, first["simhash"] == linked_["node"], "left")
    return placed.groupBy(F.coalesce("component", "simhash")).agg(F.min("at").alias("at")).select("at._row")
