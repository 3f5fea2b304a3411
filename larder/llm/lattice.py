"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors at random to one or more blocks of eight dimensions and decodes each to the nearest
point of the E8 lattice; the points name the cell, which is the bucket. A vector is at home in its own cell and looks
into it and the neighbouring cells that lie nearest, in every table; what meets is verified by its cosine.

Links aren't listed. A pair counts where it meets first (in the lowest table), so a cell adds to its vectors'
numbers of links, and of the links in a cell one for each vector is sent on, enough to join what they join. What leaves a
cell grows with the vectors that come to it, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, mapped, spread
from larder.llm.components import components


@dataclass(frozen=True)
class Grid:
    """Blocks of eight dimensions that name a cell, neighbouring cells looked into, the lattices' fineness, and tables."""

    blocks: int
    probes: int
    scale: float
    tables: int


#: By blocks: the finer the cells, the fewer unrelated vectors meet and the more tables it takes. Of pairs with a cosine of just 0.9, each
#: finds 0.996; of unrelated pairs, one in 52, in 1,400 and in 130,000 meets (measured in 64 dimensions).
GRIDS = ((1, Grid(1, 4, 5.0, 6)), (2, Grid(2, 4, 4.0, 16)), (3, Grid(3, 8, 4.0, 42)))
#: The one that is used unless another is given. It is the same for tables of every size, so whether a pair is found depends on its two vectors only.
GRID = GRIDS[0][1]
#: Vectors at home in a cell that one task holds; fuller cells are dealt to several, and their visitors sent to each.
HOMES = 4_096
#: Visitors compared at a time, and linked pairs looked up at a time.
BLOCK, PAIRS = 1_024, 100_000
#: Vectors of a task that emits, times tables.
EACH = 30_000
#: Stands for no other vector.
NONE = -(1 << 63)
SEED = 11


@lru_cache(1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all entries +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd, round the entry that was farthest off the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of the even integer points and those moved by one half in every entry, the closer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    a[closer] = b[closer]
    return a


@lru_cache(64)
def projection(dims: int, table: int, blocks: int = 1) -> np.ndarray:
    """For each block eight random directions, orthonormal as far as there are dimensions (fewer: the rest zero)."""
    q = np.linalg.qr(np.random.default_rng([SEED, dims, table]).normal(size=(dims, min(dims, 8 * blocks))))[0]
    return np.pad(q, ((0, 0), (0, 8 * blocks - q.shape[1])))


def _hash(points: np.ndarray, table: int, dims: int) -> np.ndarray:
    """64-bit cell names from lattice points (doubled, they are integers)."""
    h = np.full(points.shape[:-1], table * 1_000_003 + dims, np.uint64)
    for i in range(points.shape[-1]):
        h = (h ^ np.rint(2 * points[..., i]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(units: np.ndarray, table: int, grid: Grid) -> np.ndarray:
    """(vectors, 1 + probes) names of the cells of a table: a vector's own first. Each row by itself, so cells come out alike wherever they are made again."""
    n, dims = units.shape
    shifts = minimal_vectors()
    x = np.einsum("nd,dk->nk", units, projection(dims, table, grid.blocks) * (grid.scale * (dims / 64) ** 0.5)).reshape(n * grid.blocks, 8)
    own = decode(x)
    gain = np.einsum("nd,sd->ns", x - own, shifts).reshape(n, -1)
    nearest = np.argpartition(-gain, grid.probes, axis=1)[:, : grid.probes]
    points = np.repeat(own.reshape(n, 1, grid.blocks, 8), 1 + grid.probes, axis=1)
    block, shift = np.divmod(nearest, len(shifts))
    points[np.arange(n)[:, None], np.arange(1, 1 + grid.probes)[None, :], block] += shifts[shift]
    return _hash(points.reshape(n, 1 + grid.probes, -1), table, dims)


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, their vectors), for rows whose vectors have one length."""
    for batch in batches:
        vectors = batch.column(batch.schema.names.index("v"))
        lengths = np.array([len(x) for x in vectors])
        for dims in np.unique(lengths):
            for at in np.array_split(np.flatnonzero(lengths == dims), max(1, (lengths == dims).sum() // 500)):
                yield batch, at, np.array([vectors[i].values.to_numpy(zero_copy_only=False) for i in at.tolist()], np.float64)


def _homes(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, v in _vectors(batches):
            units = unit_rows(v)
            for t in range(grid.tables):
                yield pa.RecordBatch.from_arrays([pa.array(cells(units, t, grid)[:, 0])], names=["cell"])

    return run


def _emitted(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, table, role, id, copies, v): role 0 at home, 1 a visitor. Vectors whose components single precision holds travel in it."""
        for batch, at, v in _vectors(batches):
            raw = np.array([b"s" + a.tobytes() if (a == b).all() else b"d" + b.tobytes() for a, b in zip(v.astype("<f4"), v.astype("<f8"), strict=True)], object)
            ids, copies = (batch.column(j).to_numpy(zero_copy_only=False)[at] for j in (0, 1))
            units, n = unit_rows(v), 1 + grid.probes
            for t in range(grid.tables):
                role = np.tile((np.arange(n) > 0).astype(np.int8), len(at))
                columns = [cells(units, t, grid).ravel(), np.full(len(at) * n, t, np.int16), role, np.repeat(ids, n), np.repeat(copies, n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.repeat(raw, n), pa.binary())], names=["cell", "table", "role", "id", "copies", "v"])

    return run


def _units(column: pa.Array) -> np.ndarray:
    return unit_rows(np.array([np.frombuffer(x, "<f4" if x[:1] == b"s" else "<f8", offset=1).astype(np.float64) for x in column.to_pylist()]))


class Cell:
    """Those at home in a cell, or in one part of a full one, and what they and visitors find there."""

    def __init__(self, table: int, least: float, grid: Grid):
        self.table, self.least, self.grid = table, least, grid
        self.held: list[pa.RecordBatch] = []
        self.units = None
        self.out: list[np.ndarray] = []  # (id, copies of those it links with and meets here first, another that it links with or -1)

    def settle(self) -> None:
        """All at home are there: they visit each other."""
        if self.units is None and self.held:
            rows = pa.Table.from_batches(self.held).combine_chunks()
            self.ids, self.copies = (rows.column(c).to_numpy() for c in ("id", "copies"))
            self.units = _units(rows.column("v"))
            self.known: dict[int, np.ndarray] = {}
            self.label, self.more = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
            self.visit(self.ids, self.copies, self.units, at_home=True)

    def close(self) -> None:
        if sum(b.num_rows for b in self.held) > 1:
            self.settle()
        if self.units is not None:
            moved = self.label != np.arange(len(self.ids))
            self.out.append(np.stack([self.ids, self.more, np.where(moved, self.label, -1)], axis=1)[moved | (self.more > 0)])
            self.out[-1][:, 2] = np.where(self.out[-1][:, 2] < 0, NONE, self.ids[self.out[-1][:, 2]])

    def visitors(self, rows: pa.RecordBatch) -> None:
        if self.held:
            self.settle()
            for k in range(0, rows.num_rows, BLOCK):
                some = rows.slice(k, BLOCK)
                self.visit(*(some.column(some.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("id", "copies")), _units(some.column(some.schema.names.index("v"))))

    def visit(self, ids: np.ndarray, copies: np.ndarray, units: np.ndarray, at_home: bool = False) -> None:
        for k in range(0, len(ids), BLOCK):
            i, j = np.nonzero(units[k : k + BLOCK] @ self.units.T >= self.least)
            other = ids[k + i] != self.ids[j]
            i, j = k + i[other], j[other]
            if not len(i):
                continue
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            self.join(np.repeat(j[starts], np.diff(np.append(starts, len(i)))), j)
            if at_home:
                self.join(i, j)
            more = np.zeros(len(ids), np.int64)
            for q in range(0, len(i), PAIRS):
                a, b = self.first(ids, units, i[q : q + PAIRS], j[q : q + PAIRS])
                np.add.at(more, a, self.copies[b])
                np.add.at(self.more, b, copies[a])
            if at_home:
                self.more += more
            else:
                self.out.append(np.stack([ids[i[starts]], more[i[starts]], self.ids[j[starts]]], axis=1))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Those at home that a and b pair have one label from now on, the place of one of them."""
        label = self.label
        while True:
            apart = label[a] != label[b]
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label[:] = label[label]

    def of_homes(self, table: int) -> np.ndarray:
        if table not in self.known:
            self.known[table] = cells(self.units, table, self.grid)
        return self.known[table]

    def first(self, ids: np.ndarray, units: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (visitor, at home) that meet in no lower table; of two that visit each other in this one, the larger id counts."""
        for t in range(self.table + 1):
            if not len(i):
                break
            some, at = np.unique(i, return_inverse=True)
            theirs, ours = cells(units[some], t, self.grid), self.of_homes(t)
            mutual = (ours[j] == theirs[at, :1]).any(axis=1)
            before = mutual & (ids[i] < self.ids[j]) if t == self.table else mutual | (theirs[at] == ours[j, :1]).any(axis=1)
            i, j = i[~before], j[~before]
        return i, j


def _verified(least: float, grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and part, those at home first: they are held, at most a few times HOMES, and visitors pass by."""

        def told(done: list[Cell]) -> Iterator[pa.RecordBatch]:
            out = [x for c in done for x in c.out if len(x)]
            for c in done:
                c.out = []
            if out:
                every = np.concatenate(out)
                none = every[:, 2] == NONE
                yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(every[:, 2], mask=none)], names=["id", "n", "other"])

        key, now = None, None
        for batch in batches:
            cell, part, table, role = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), [True]]))
            done = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if (cell[a], part[a]) != key:
                    if now:
                        now.close()
                        done.append(now)
                    key, now = (cell[a], part[a]), Cell(int(table[a]), least, grid)
                mid = a + int((role[a:b] == 0).sum())
                if mid > a:
                    now.held.append(batch.slice(a, mid - a))
                if b > mid:
                    now.visitors(batch.slice(mid, b - mid))
            yield from told([*done, now] if now else done)
        if now:
            now.close()
            yield from told([now])

    return run


def found(classes: DataFrame, least: float, grid: Grid) -> DataFrame:
    """(id, n, other) for classes (id, copies, v) that link with others: copies of others by a cell where they meet first, and one of those
    that it links with there (null if others are joined with it). Cells are made twice, so that what is emitted is shuffled and nowhere else written."""
    full = classes.select("v").transform(mapped, _homes(grid), "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > HOMES)
    full = checkpoint(full.select("cell", F.ceil(F.col("n") / HOMES).alias("parts")))  # few: a cell on it has over HOMES vectors
    rows = classes.transform(spread, "id", EACH // grid.tables).transform(mapped, _emitted(grid), "cell long, table short, role byte, id long, copies long, v binary")
    dealt = rows.join(full, "cell", "left") if full.count() else rows.withColumn("parts", F.lit(None).cast("long"))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    place = lambda part, role: F.struct(part.alias("part"), role.cast("byte").alias("role"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: place(p, F.when((F.col("role") == 0) & (p == own), 0).otherwise(1)))
    placed = F.when(F.col("parts").isNull(), F.array(place(F.lit(0).cast("long"), F.col("role")))).otherwise(every)
    dealt = dealt.select("cell", F.explode(placed).alias("p"), "table", "id", "copies", "v").select("cell", "p.part", "table", "p.role", "id", "copies", "v")
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "role").transform(mapped, _verified(least, grid), "id long, n long, other long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", grid: Grid | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: how many others it links with directly, the smallest key reachable, and whether that is its own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows
    whose key is null. Vectors of different lengths never link. Equal vectors form a class that counts as often as it has rows, so copies
    are never paired with each other; repeated rows count each; classes whose smallest key is the same (a key with several vectors) are one
    node, which has all their links. Links below `least` never occur; those at or above it are found with the
    probability that the tables give, a pair of vectors in one table as in any other. Other columns are not carried.
    """
    fine = F.size(vector) > 0
    fine &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    plain = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = checkpoint(vectors.select(F.col(key).cast("long").alias("id"), F.when(fine & F.col(key).isNotNull(), plain).alias("v")))
    hashed = rows.withColumn("h", F.xxhash64("v"))
    classes = checkpoint(hashed.where("v IS NOT NULL").groupBy("h", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    linked = checkpoint(found(classes.select(F.col("first").alias("id"), "copies", "v"), least, grid or GRID))
    degree = linked.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("others"))
    placed = degree.join(components(linked.where("other IS NOT NULL").select("id", "other")), "node", "left")
    named = classes.select("h", "v", "first", "copies").join(placed, F.col("first") == F.col("node"), "left")
    named = checkpoint(named.select("h", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")))
    out = hashed.join(named.withColumnRenamed("v", "_v").withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


#: The same in DuckDB over all pairs. It equals the tables' result where these find every link, as on the small tables here.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
                     AND NOT list_contains([x IS NOT NULL AND isfinite(x) FOR x IN embedding], false) AND list_contains([x <> 0 FOR x IN embedding], true)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component, e.vec_id) AS component_id, e.vec_id = coalesce(c.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
