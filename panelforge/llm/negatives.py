"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Vectors are whole numbers (components times a scale, floored). They are ordered along a Hilbert curve within each label, cut into
blocks and written as Parquet in that order; a zone map holds the least and the largest value of every dimension of a block. An
anchor asks for the best rows whose inner product lies in a window. Interval arithmetic over a block's zone map bounds all
inner products in it, and only blocks whose bounds meet a window are read and compared.

Two searches answer an anchor. Its positives: the best rows of its own label, where the anchor's own block, compared
first, gives a threshold for the other blocks. Its negatives: for each positive the best rows of other labels
within a window of scores that hangs on the positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import staged

#: Rows of a block; anchors of a pass, whose vectors are broadcast (at most ANCHORS * dimensions * 8 bytes); entries kept before they are cut.
BLOCK, ANCHORS, ENTRIES = 256, 16384, 1 << 20
#: The Hilbert curve runs through the dimensions of largest spread: CURVE_DIMS of 2 ** CURVE_BITS steps each, 64 bits at most.
CURVE_DIMS, CURVE_BITS = 16, 4
#: Scores are 64-bit; rows whose squared length reaches this take no part.
MAX_SQUARE = 2.0**62
LOWEST, HIGHEST = -(1 << 62), 1 << 62
ROWS = "block long, label long, vec_id long, q array<long>"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2 ** bits: coordinates are turned level by level, then Gray-decoded."""
    x = cells.T.astype(np.uint64).copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << one | (x[i] >> np.uint64(level) & one)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension count, sum and sum of squares of a task's vectors."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for vector in _by_size(batch):
            q = _matrix(vector.column("q")).astype(np.float64)
            part = np.stack([np.full(q.shape[1], float(len(q))), q.sum(axis=0), (q * q).sum(axis=0)])
            total[q.shape[1]] = total.get(q.shape[1], 0) + part
    for size, (n, s, ss) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(n), pa.array(s), pa.array(ss)], ["size", "dim", "n", "s", "ss"])


def _by_size(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    sizes = np.diff(batch.column("q").offsets.to_numpy())
    return [batch.take(pa.array(np.flatnonzero(sizes == d))) for d in np.unique(sizes)]


def _curve(axes: dict[int, tuple]):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their place on the curve of their number of dimensions."""
        for batch in batches:
            for part in _by_size(batch):
                q = _matrix(part.column("q"))
                place = np.zeros(part.num_rows, dtype=np.uint64)
                if q.shape[1]:
                    dims, low, step = axes[q.shape[1]]
                    cells = np.clip((q[:, dims] - low) / step, 0, 2**CURVE_BITS - 1).astype(np.uint64)
                    place = hilbert_index(cells, CURVE_BITS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((place >> np.uint64(1)).astype(np.int64))], [*part.schema.names, "place"])

    return placed


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their block: a new one after BLOCK rows or where label or size change."""
    block, held, last = TaskContext.get().partitionId() << 32, 0, None
    for batch in batches:
        keys = list(zip(batch.column("label").to_pylist(), np.diff(batch.column("q").offsets.to_numpy())))
        out = np.empty(len(keys), dtype=np.int64)
        for i, key in enumerate(keys):
            if key != last or held == BLOCK:
                block, held, last = block + (last is not None), 0, key
            out[i], held = block, held + 1
        yield pa.RecordBatch.from_arrays([pa.array(out), *[batch.column(c) for c in ("label", "vec_id", "q")]], ["block", "label", "vec_id", "q"])


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and largest value per dimension of each block (of each part, where a block spans two batches)."""
    for batch in batches:
        for part, block, label, _, q in _blocks(batch):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([label]), pa.array([q.min(axis=0).tolist()], pa.list_(pa.int64())), pa.array([q.max(axis=0).tolist()], pa.list_(pa.int64()))], ["block", "label", "low", "high"])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    block = batch.column("block").to_numpy()
    if not len(block):
        return
    starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
    for b, e in zip(starts[:-1], starts[1:]):
        part = batch.slice(b, e - b)
        yield part, int(block[b]), int(part.column("label")[0].as_py()), part.column("vec_id").to_numpy(), _matrix(part.column("q"))


class Search:
    """The windows of a pass of anchors: per anchor and window the best rows met so far."""

    def __init__(self, held: dict, top: int):
        self.__dict__.update(held)  # ids, labels, home, q (anchors x size), low, high (anchors x windows), mode
        self.top, self.low = top, self.low.copy()
        self.f = self.q.astype(np.float64)
        self.up, self.down, self.square = np.maximum(self.f, 0), np.minimum(self.f, 0), (self.f**2).sum(axis=1)
        self.best = np.empty((0, 3), dtype=np.int64)  # anchor * windows + window, score, id
        self.fresh, self.n_fresh = [], 0

    def wanted(self, block: int, label: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors with a window that the bounds of a block meet."""
        low, high = low.astype(np.float64), high.astype(np.float64)
        spare = 1e-9 * (np.abs(self.f) @ np.maximum(np.abs(low), np.abs(high)))  # beyond any rounding of the bounds
        upper = self.up @ high + self.down @ low + spare
        lower = self.up @ low + self.down @ high - spare
        meets = ((upper[:, None] >= self.low) & (lower[:, None] <= self.high)).any(axis=1)
        own = self.labels == label
        return np.flatnonzero(meets & (own & (self.home == block) if self.mode == "home" else own & (self.home != block) if self.mode == "own" else ~own))

    def compare(self, block: int, label: int, ids: np.ndarray, q: np.ndarray) -> None:
        at = self.wanted(block, label, q.min(axis=0), q.max(axis=0))
        if not len(at):
            return
        if self.square[at].max() * (q.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**104:  # every sum stays below 2 ** 52: exact in doubles
            score = (self.f[at] @ q.T.astype(np.float64)).astype(np.int64)
        else:
            score = self.q[at] @ q.T
        other = (self.ids[at][:, None] != ids) | (self.mode == "other")
        for w in range(self.low.shape[1]):
            i, j = np.nonzero(other & (score >= self.low[at, w, None]) & (score <= self.high[at, w, None]))
            self.fresh.append(np.stack([at[i] * self.low.shape[1] + w, score[i, j], ids[j]], axis=1))
            self.n_fresh += len(i)
        if self.n_fresh > ENTRIES:
            self.cut()

    def cut(self) -> None:
        """Keep the best rows of each window; a window that has them all asks for no lower score from now on."""
        rows = np.concatenate([self.best, *self.fresh])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        n = len(rows)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if n else np.empty(0, dtype=np.int64)
        rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        self.best, self.fresh, self.n_fresh = rows[rank < self.top], [], 0
        full = rows[rank == self.top - 1]
        a, w = np.divmod(full[:, 0], self.low.shape[1])
        self.low[a, w] = np.maximum(self.low[a, w], full[:, 1])


def _searched(shared, top: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task's blocks offer to each window."""
        searches = {d: Search(held, top) for d, held in shared.value.items()}
        for batch in batches:
            for _, block, label, ids, q in _blocks(batch):
                if q.shape[1] in searches:
                    searches[q.shape[1]].compare(block, label, ids, q)
        for s in searches.values():
            s.cut()
            a, w = np.divmod(s.best[:, 0], s.low.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(s.row[a]), pa.array(w), pa.array(s.best[:, 1]), pa.array(s.best[:, 2])], ["anchor", "w", "score", "vec_id"])

    return searched


def _chosen(shared, top: int):
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that some anchor's windows must read."""
        searches = {d: Search(held, top) for d, held in shared.value.items()}
        for batch in batches:
            blocks, labels = batch.column("block").to_pylist(), batch.column("label").to_pylist()
            low, high = batch.column("low"), batch.column("high")
            use = []
            for i, (block, label) in enumerate(zip(blocks, labels)):
                a, b = low[i].values.to_numpy(), high[i].values.to_numpy()
                if len(a) in searches and len(searches[len(a)].wanted(block, label, a, b)):
                    use.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(use, pa.int64())], ["block"])

    return chosen


class CandidateBlocks:
    """Quantised vectors in Hilbert-ordered blocks, written once, with their zone maps.

    ``rows`` (block, label, vec_id, q) lies in curve order inside each label, so a block's rows are neighbours; ``zones`` has
    a row for each block.
    """

    def __init__(self, rows: DataFrame):
        """``rows`` has vec_id, label and q (whole numbers), none of them null."""
        spark = rows.sparkSession
        rows = staged(rows, "quantised-vectors")
        moments = rows.select("q").mapInArrow(_moments, "size long, dim long, n double, s double, ss double").groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toPandas()
        axes = {}
        for size, m in moments.sort_values(["size", "dim"]).groupby("size"):
            mean = (m["s"] / m["n"]).to_numpy()
            spread = np.sqrt(np.maximum((m["ss"] / m["n"]).to_numpy() - mean**2, 0))
            dims = np.argsort(-spread, kind="stable")[:CURVE_DIMS]
            axes[int(size)] = (dims, mean[dims] - 2 * spread[dims], np.maximum(4 * spread[dims] / 2**CURVE_BITS, 1e-9))
        placed = rows.mapInArrow(_curve(axes), "vec_id long, label long, q array<long>, place long")
        order = ["label", "size", "place", "vec_id"]
        placed = staged(placed.withColumn("size", F.size("q")), "curve-places")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "vec_id", "q").mapInArrow(_numbered, ROWS)
        self.rows = staged(numbered, "candidate-blocks")
        self.zones = staged(self.rows.mapInArrow(_zones, "block long, label long, low array<long>, high array<long>"), "zone-maps")

    def search(self, anchors: dict[int, dict], top: int) -> DataFrame:
        """anchor (row number), w, found (at most ``top`` structs (lost, vec_id), best first, lost = -score) for a pass of anchors."""
        shared = self.rows.sparkSession.sparkContext.broadcast(anchors)
        wanted = self.zones.mapInArrow(_chosen(shared, top), "block long").distinct()
        found = self.rows.join(wanted, "block", "left_semi").select("block", "label", "vec_id", "q").mapInArrow(_searched(shared, top), "anchor long, w long, score long, vec_id long")
        return self.best(found.select("anchor", "w", F.struct((-F.col("score")).alias("lost"), "vec_id").alias("hit")), top)

    @staticmethod
    def best(hits: DataFrame, top: int) -> DataFrame:
        """The best hits of each window: tasks offer at most ``top`` each."""
        return hits.groupBy("anchor", "w").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, top).alias("found"))


def quantised(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, q of the rows that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    square = F.aggregate(F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return rows.where(square < MAX_SQUARE).select("vec_id", "label", whole.alias("q"))


def _packed(rows: list, windows: dict[int, list[tuple[int, int]]] | None, mode: str) -> dict[int, dict]:
    """Anchors by size as arrays. ``windows`` has (low, high) per anchor's row number; short lists are filled with empty windows."""
    out: dict[int, list] = {}
    for k, r in enumerate(rows):
        out.setdefault(len(r["q"]), []).append((k, r))
    packed = {}
    for size, own in out.items():
        spans = [windows.get(k, []) if windows is not None else [(LOWEST, HIGHEST)] for k, _ in own]
        width = max(map(len, spans), default=0)
        full = np.array([s + [(HIGHEST, LOWEST)] * (width - len(s)) for s in spans], dtype=np.int64).reshape(len(own), width, 2)
        packed[size] = {
            "row": np.array([k for k, _ in own], dtype=np.int64), "ids": np.array([r["vec_id"] for _, r in own], dtype=np.int64), "labels": np.array([r["label"] for _, r in own], dtype=np.int64),
            "home": np.array([r["block"] for _, r in own], dtype=np.int64), "q": np.array([list(r["q"]) for _, r in own], dtype=np.int64).reshape(len(own), size), "low": full[:, :, 0], "high": full[:, :, 1], "mode": mode,
        }
    return packed


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 5, floor_percent: int = 80, anchors_per_pass: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    ``is_anchor`` is a condition over vec_id, ``label`` an expression over ``vectors`` (default: its column label). Rows without
    vec_id, label or vector, or with a null or non-finite component, take no part; nor do those whose scaled squared length passes
    ``MAX_SQUARE``, as scores are 64-bit. Vectors of different lengths are never compared. A score is the inner product of
    the components times ``scale``, floored; higher ones come first, ties by smaller vec_id. An anchor's positives are the best
    ``positives`` rows of its label and another vec_id; a positive's negatives the best ``negatives`` rows of other labels with
    floor_percent * positive_score <= 100 * negative_score <= 100 * positive_score. Repeated rows are rows of
    their own, as anchors and as candidates. Fewer rows than asked for are all returned; a positive with a negative score
    has none. Other columns are ignored.

    Anchors are taken in passes of about ``anchors_per_pass``, whose vectors are all that is broadcast or collected; all
    blocks that a pass must read are compared where they lie. Each task keeps the best rows of each window and sends only those.
    """
    blocks = CandidateBlocks(quantised(vectors, vec_id, embedding, F.col("`label`") if label is None else label, scale))
    anchors = staged(blocks.rows.where(is_anchor), "anchors")
    passes = 1 + anchors.count() // anchors_per_pass
    spark, out = vectors.sparkSession, []
    for p in range(passes):
        rows = anchors.where(F.pmod(F.xxhash64("vec_id", "block"), F.lit(passes)) == p).collect()
        home = blocks.search(_packed(rows, None, "home"), positives).collect()
        near = {r["anchor"]: r["found"] for r in home}
        reach = {k: [(-near[k][-1]["lost"] if len(near.get(k, [])) == positives else LOWEST, HIGHEST)] for k in range(len(rows))}
        rest = blocks.search(_packed(rows, reach, "own"), positives).collect()
        for r in rest:
            near[r["anchor"]] = sorted([*near.get(r["anchor"], []), *r["found"]])[:positives]
        pairs = [(k, w, rows[k]["vec_id"], hit["vec_id"], -hit["lost"]) for k in sorted(near) for w, hit in enumerate(near[k])]
        windows: dict[int, list[tuple[int, int]]] = {}
        for k, _, _, _, score in pairs:
            windows.setdefault(k, []).append((-(-floor_percent * score // 100), score))
        told = spark.createDataFrame(pd.DataFrame(pairs, columns=["anchor", "w", "anchor_id", "positive_id", "positive_score"]).astype("int64"), "anchor long, w long, anchor_id long, positive_id long, positive_score long")
        found = staged(blocks.search(_packed(rows, windows, "other"), negatives).join(F.broadcast(told), ["anchor", "w"]), "hard-negatives")
        out.append(found.select("anchor_id", "positive_id", F.posexplode("found").alias("at", "hit"), "positive_score"))
    result = reduce(DataFrame.unionByName, out)
    return result.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("negative_id"), "positive_score", (-F.col("hit.lost")).alias("negative_score"))
