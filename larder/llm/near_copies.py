"""Links between near copies that fingerprints miss: five-word shingles with a Jaccard similarity of 0.8 or more.

At a similarity of 0.8 two fingerprints differ in some ten bits of 64, more than balls can be drawn for. So a
stage that has to find such copies takes further candidates: texts that share a band of minima of their
hashed shingles meet under the band, with a sketch of all minima (a byte each). Sketches that agree like
those of sets at 0.9 or above are linked; between 0.7 and that, the sets themselves are compared.
Under a band that many share, each is compared with leaders only (those not linked to an earlier
leader), and sends on the nearest: what is sent grows with the rows, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, mapped, sliced, texts, whole_runs

WORDS, LEAST, SEED = 5, "0.8", 42
#: Two at a similarity of s share a band with 1 - (1 - s^ROWS)^BANDS: 0.99994 at 0.8.
BANDS, ROWS = 32, 6
#: Sketches of sets at 0.8 agree like those at 0.9 or above, or like those below 0.7, with 0.0003 each.
SURE, MAYBE = 0.9, 0.7
#: Up to so many under a band are compared in pairs.
PAIRS = 24
#: Rows under a band that one task compares; fuller bands are dealt to several tasks, and their leaders on.
HOMES = 4_096
#: Rows of texts to compare are told from others by so many classes first, in a table of bounded size.
CLASSES = 1 << 18
_rng = np.random.default_rng(SEED)
_xor, _odd = (_rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_odd |= np.uint64(1)


def least_agreeing(similarity: float) -> int:
    """Bytes that agree in the sketches of two sets of this similarity, rounded up: unequal minima agree by chance once in 256."""
    return int(np.ceil(BANDS * ROWS * (similarity + (1 - similarity) / 256)))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the shingles of the lower-cased text; a shorter text is one shingle, a blank one has none."""
    words = text.lower().encode(errors="replace").split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(max(1, len(words) - WORDS + 1))] if words else [], np.uint64))


def sketch(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(a key for each band, the last byte of every minimum); none for no shingles."""
    if not len(found):
        return np.empty(0, np.int64), b""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 512):
        mixed = found[k : k + 512, None] ^ _xor
        mixed *= _odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= _odd[::-1]
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return keys.view(np.int64), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1, dtype=np.int16)


def led(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader, member, bytes that agree) of a run: for each member the nearest earlier leader, if near enough. A member is a leader itself unless surely linked to one."""
    sure, maybe = least_agreeing(SURE), least_agreeing(MAYBE)
    leaders, out = np.empty(0, np.int64), []
    for k in range(0, len(sigs), 128):
        mine = sigs[k : k + 128]
        best, who = np.zeros(len(mine), np.int16), np.zeros(len(mine), np.int64)
        for q in range(0, len(leaders), 512):
            agree = agreeing(mine[:, None, :], sigs[leaders[q : q + 512]][None, :, :])
            at = agree.argmax(axis=1)
            value = agree[np.arange(len(mine)), at]
            closer = value > best
            best[closer], who[closer] = value[closer], leaders[q + at[closer]]
        inner, fresh = agreeing(mine[:, None, :], mine[None, :, :]), []
        for i in range(len(mine)):
            if fresh and (m := int(inner[i, fresh].max())) > best[i]:
                best[i], who[i] = m, k + fresh[int(inner[i, fresh].argmax())]
            if best[i] < sure:
                fresh.append(i)
        leaders = np.concatenate([leaders, k + np.array(fresh, np.int64)])
        near = np.flatnonzero(best >= maybe)
        out.append((who[near], k + near, best[near]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, node, sig) rows, sorted by the first two, to (key, a, b, sure), b the later one."""
    for key, part, node, raw in whole_runs(batches, 2):
        sigs = np.frombuffer(b"".join(raw.tolist()), np.uint8).reshape(len(key), BANDS * ROWS)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        run, of = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
        short = np.flatnonzero((of > 1) & (of <= PAIRS))
        found = []
        for lag in range(1, PAIRS):
            a, b = short[:-lag], short[lag:]
            together = run[a] == run[b]
            if not together.any():
                break
            a, b = a[together], b[together]
            agree = agreeing(sigs[a], sigs[b])
            near = agree >= least_agreeing(MAYBE)
            found.append((a[near], b[near], agree[near]))
        for s, n in zip(starts[sizes > PAIRS].tolist(), sizes[sizes > PAIRS].tolist(), strict=True):
            a, b, agree = led(sigs[s : s + n])
            found.append((s + a, s + b, agree))
        if found:
            a, b, agree = (np.concatenate([x[i] for x in found]) for i in range(3))
            sure = agree >= least_agreeing(SURE)
            yield pa.RecordBatch.from_arrays([pa.array(key[b]), pa.array(node[a]), pa.array(node[b]), pa.array(sure)], names=["key", "a", "b", "sure"])


def met(nodes: DataFrame) -> DataFrame:
    """(a, b, sure) of nodes (node, sig, keys) that share a band and whose sketches agree. A band with over HOMES rows is dealt to tasks,
    and its leaders again, until one task has them all; where they don't get fewer, every two parts of them are brought together."""
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = checkpoint(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    now = bands.join(shared, "key").join(nodes.select("node", "sig"), "node").withColumn("stuck", F.lit(False))
    every, full = [], not shared.where(F.col("n") > HOMES).isEmpty()
    while True:
        parts = F.ceil(F.col("n") / HOMES)
        own = F.pmod(F.xxhash64("node", F.lit(len(every))), parts)
        part = F.when(F.col("stuck"), F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda q: F.least(own, q) * parts + F.greatest(own, q))).otherwise(F.array(own))
        dealt = now.select("key", F.explode(part).alias("part"), "node", "sig")
        found = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node")
        every.append(checkpoint(found.transform(mapped, compared, "key long, a long, b long, sure boolean")))
        if not full:
            break
        gone = every[-1].where("sure").select("key", F.col("b").alias("node")).distinct()
        left = checkpoint(now.where((F.col("n") > HOMES) & ~F.col("stuck")).join(gone, ["key", "node"], "left_anti"))
        sizes = left.groupBy("key").agg(F.count("*").alias("m"))
        now = checkpoint(left.join(sizes, "key").withColumn("stuck", (F.col("m") > HOMES) & (4 * F.col("m") > 3 * F.col("n"))).drop("n").withColumnRenamed("m", "n"))
        if now.isEmpty():
            break
    pairs = every[0]
    for more in every[1:]:
        pairs = pairs.unionByName(more)
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, text) to (_row, held)."""
    for batch in batches:
        sets = [shingles(t) for t in texts(batch.column(1))]
        for i, j in sliced((n, 8 * len(s)) for n, s in enumerate(sets)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.view(np.int64) for s in sets[i:j]], pa.list_(pa.int64()))], names=["_row", "held"])


def near(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose sets have a similarity of LEAST or more. Sets are made of the texts of these nodes only."""
    wanted = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "_row"), "node"))
    kind = F.pmod(F.xxhash64("_row"), F.lit(CLASSES))
    held = docs.join(F.broadcast(wanted.select(kind.alias("class")).distinct()), kind == F.col("class"), "left_semi")
    sets = mapped(held.select("_row", "text"), _sets, "_row string, held array<long>").join(wanted, "_row")
    sets = checkpoint(sets.groupBy("node").agg(F.any_value("held").alias("held")))
    one, two = (sets.select(F.col("node").alias(n), F.col("held").alias(f"of_{n}")) for n in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(f"shared >= {LEAST} * (size(of_a) + size(of_b) - shared)").select("a", "b")


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between nodes (node, _row, sig, keys); docs (_row, text) has their texts."""
    pairs = checkpoint(met(nodes))
    return pairs.where("sure").select("a", "b").unionByName(near(pairs.where("NOT sure").select("a", "b"), nodes, docs))
