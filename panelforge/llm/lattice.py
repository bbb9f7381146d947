"""Embedding near-duplicates: random projections decoded to the E8 lattice in several tables.

Each table projects a unit vector to blocks of 8 dimensions and decodes every block to its nearest E8 lattice point; the
points of all blocks are the vector's cell. A vector is also filed under neighbouring cells, those whose centres come next
nearest in one block. Vectors of one label that meet in a cell of any table are compared by cosine in double
precision, so nothing below the threshold is linked; the tables and neighbours decide how few links are missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import staged
from panelforge.llm.components import connected_components
from panelforge.llm.runs import gathered, local_roots, runs, spread_hot_groups

#: Vectors compared in one go; cells beyond it are dealt out in pairs of parts.
CHUNK = 256
GROUP = ["cell", "label", "length", "part_a", "part_b"]


@dataclass(frozen=True)
class LatticeTables:
    """Tables, 8-dimensional blocks per table, neighbouring cells probed per table, cell width, seed.

    ``width`` is the edge of the lattice in units of a unit vector's spread along one projected axis.
    """

    tables: int = 6
    blocks: int = 2
    probes: int = 3
    width: float = 1.25
    seed: int = 17


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row: the better of the nearest points of D8 and of D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        point = np.rint(y)
        off = y - point
        worst = np.abs(off).argmax(axis=1)
        rows = np.flatnonzero(point.sum(axis=1) % 2 != 0)
        w = worst[rows]
        point[rows, w] += np.where(off[rows, w] >= 0, 1.0, -1.0)
        return point

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or all entries +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([-0.5 if signs >> i & 1 else 0.5 for i in range(8)])
        if bin(signs).count("1") % 2 == 0:
            out.append(v)
    return np.array(out)


class Projection:
    """The random axes of every table for vectors of ``d`` dimensions; the same on every executor."""

    def __init__(self, shape: LatticeTables, d: int):
        rng = np.random.default_rng([shape.seed, d])
        self.shape = shape
        self.axes = rng.standard_normal((shape.tables, shape.blocks, d, 8)) / shape.width
        self.factors = rng.integers(1, 2**63, size=(shape.tables, shape.blocks, 8), dtype=np.uint64) | np.uint64(1)
        self.steps = minimal_vectors()

    def numbered(self, points: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Lattice points (or steps between them) as numbers that add up like the points."""
        return ((2 * points).astype(np.int64).view(np.uint64) * factors).sum(axis=-1, dtype=np.uint64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell numbers (rows x tables x 1 + probes, int64) of unit vectors; the first of each table is the home cell."""
        tables, blocks, probes = self.shape.tables, self.shape.blocks, self.shape.probes
        out = np.empty((len(unit), tables, 1 + probes), dtype=np.uint64)
        for t in range(tables):
            home, near, gain = np.zeros(len(unit), dtype=np.uint64), [], []
            for k in range(blocks):
                y = unit @ self.axes[t, k]
                point = nearest_e8(y)
                home += self.numbered(point, self.factors[t, k])
                toward = (y - point) @ self.steps.T  # the cell over a step is nearer the larger this is
                best = np.argpartition(-toward, probes, axis=1)[:, :probes]
                near.append(self.numbered(self.steps[best], self.factors[t, k]))
                gain.append(np.take_along_axis(toward, best, axis=1))
            best = np.argsort(-np.concatenate(gain, axis=1), axis=1, kind="stable")[:, :probes]
            out[:, t, 0] = home
            out[:, t, 1:] = home[:, None] + np.take_along_axis(np.concatenate(near, axis=1), best, axis=1)
            out[:, t] = (out[:, t] ^ (out[:, t] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
        return out.view(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _unit(column) -> np.ndarray:
    m = _matrix(column, np.float64)
    m = m / np.abs(m).max(axis=1)[:, None]  # no overflow of squares
    return m / np.linalg.norm(m, axis=1)[:, None]


def _filed(shape: LatticeTables):
    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each vector."""
        known: dict[int, Projection] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                sizes = part.column("length").to_numpy()
                for d in np.unique(sizes):
                    p = part.take(pa.array(np.flatnonzero(sizes == d)))
                    if d not in known:
                        known[d] = Projection(shape, int(d))
                    cells = known[d].cells(_unit(p.column("vector"))).reshape(p.num_rows, -1)
                    p = p.select(["rep", "label", "length"]).take(pa.array(np.repeat(np.arange(p.num_rows), cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *p.columns], ["cell", "rep", "label", "length"])

    return filed


def _meet_before(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs (cells of the one, cells of the other) also meet in a cell before ``cell``: of an earlier table, or lower in its own."""
    before, arrived = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
    for t in range(a.shape[1]):
        same = (a[:, t, :, None] == b[:, t, None, :]).reshape(len(a), -1)
        values = np.repeat(a[:, t], b.shape[2], axis=1)
        lowest = np.where(same, values, np.iinfo(np.int64).max).min(axis=1)
        meets = same.any(axis=1) & ~arrived & ~before
        arrived |= meets & (lowest == cell)
        before |= meets & (lowest != cell)
    return before


def _compared(shape: LatticeTables, threshold: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per vector and group its links and the lowest vector of its part of the group."""
        known: dict[int, Projection] = {}
        for t, starts, ends in runs(batches, GROUP):
            reps, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
            cell, length = t.column("cell").to_numpy(), t.column("length").to_numpy()
            own, part_a, part_b = (t.column(c).to_numpy() for c in ("own_part", "part_a", "part_b"))
            vectors = t.column("vector").combine_chunks()
            out, pairs = [], []
            for b, e in zip(starts, ends):
                unit = _unit(vectors.slice(b, e - b))
                linked = np.triu(unit @ unit.T >= threshold, 1)
                if part_a[b] != part_b[b]:
                    linked &= own[b:e, None] != own[None, b:e]
                i, j = np.nonzero(linked)
                if len(i):
                    if int(length[b]) not in known:
                        known[int(length[b])] = Projection(shape, int(length[b]))
                    pairs.append((b, e, i, j))
            for d, found in _by_length(pairs, length).items():
                rows = np.concatenate([np.arange(b, e) for b, e, _, _ in found])
                ids, first, place = np.unique(reps[rows], return_index=True, return_inverse=True)
                cells = known[d].cells(_unit(vectors.take(pa.array(rows[first]))))
                at = 0
                for b, e, i, j in found:
                    mine = cells[place[at : at + e - b]]
                    at += e - b
                    fresh = np.concatenate([~_meet_before(mine[i[k : k + 65536]], mine[j[k : k + 65536]], cell[b]) for k in range(0, len(i), 65536)])
                    linked = np.zeros((e - b, e - b), dtype=bool)
                    linked[i[fresh], j[fresh]] = True
                    both = linked | linked.T
                    use = np.flatnonzero(both.any(axis=1))
                    out.append((reps[b:e][use], (both @ copies[b:e])[use], reps[b:e][local_roots(linked)[use]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["rep", "links", "root"])

    return compared


def _by_length(pairs: list, length: np.ndarray) -> dict[int, list]:
    out: dict[int, list] = {}
    for p in pairs:
        out.setdefault(int(length[p[0]]), []).append(p)
    return out


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, shape: LatticeTables = LatticeTables()) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine reaches ``threshold``. Null or empty vectors, zero
    vectors and vectors with a null or non-finite component link with nothing. Equal vectors of a label are one node
    with a number of copies. n_links counts other rows linked directly, so repeated rows of one vec_id count each other.
    Rows without a vec_id are counted as neighbours and name no component; their own component_id is null and kept
    false if no id is reachable.

    Groups of nearly equal vectors are compared part against part inside tasks; per vector only its number of links and one
    link towards the rest of its group leave the task. A pair that meets in several cells counts in the first.
    """
    kind = dict(vectors.dtypes)[embedding]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = F.col(f"`{embedding}`").cast(kind)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    nodes = rows.where(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # A class gets a number of its own once, in a written table; its rows are found again by label and vector.
    nodes = staged(nodes.withColumn("rep", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vector-classes")
    filed = nodes.select("rep", "label", "length", "vector").mapInArrow(_filed(shape), "cell long, rep long, label long, length int")
    dealt = spread_hot_groups(staged(filed, "vector-cells"), ["cell", "label", "length"], F.xxhash64("rep"), CHUNK)
    members = dealt.join(nodes.select("rep", "copies", "vector"), "rep")
    found = gathered(members, GROUP).mapInArrow(_compared(shape, threshold), "rep long, links long, root long")
    found = staged(found, "vector-links")
    roots = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = staged(nodes.select("rep", "label", "vector", "low", "copies").join(roots, "rep", "left").join(counts, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "vector-nodes")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = named.join(lows, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where(usable).join(facts, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
