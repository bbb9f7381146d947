"""Work on groups of rows inside sorted partitions, and on groups too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import staged

def spread_hot_groups(rows: DataFrame, keys: list[str], salt: Column, chunk: int) -> DataFrame:
    """Rows of groups of two or more, with ``part_a``, ``part_b`` and ``own_part``, so that all pairs of a group meet in bounded groups.

    A group of at most ``chunk`` rows has (0, 0). A larger one is dealt by ``salt`` (which must differ between its rows)
    into parts of about ``chunk`` rows, and each row is sent to the pairs (a, b), a <= b, of its part with every part: two
    rows of different parts meet once, rows of one part meet in (a, a).
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_rows")).where(F.col("group_rows") > 1)
    shared = staged(rows.join(sizes, keys), "shared-groups")
    zero = F.lit(0)
    cold = shared.where(F.col("group_rows") <= chunk).select(*rows.columns, zero.alias("part_a"), zero.alias("part_b"), zero.alias("own_part"))
    parts = F.ceil(F.col("group_rows") / chunk).cast("int")
    dealt = shared.where(F.col("group_rows") > chunk).select(*rows.columns, F.pmod(salt, parts).cast("int").alias("own_part"), parts.alias("parts"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select(*rows.columns, F.least("own_part", "other").alias("part_a"), F.greatest("own_part", "other").alias("part_b"), "own_part")
    return cold.unionByName(dealt)


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal ``keys`` side by side in one partition, ready for :func:`runs`."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole runs of equal ``keys`` with the starts and ends of the runs of two rows or more.

    Rows must come sorted by ``keys`` (integers). Only the last run of a batch is carried over to the next.
    """
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        n = t.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        last = int(starts[-1])
        if last:
            yield _multiple(t.slice(0, last), starts[:-1], starts[1:])
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield _multiple(rest, np.array([0]), np.array([rest.num_rows]))


def _multiple(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    some = ends - starts > 1
    return t, starts[some], ends[some]


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a small graph (square boolean matrix) the lowest node it can reach."""
    n = len(linked)
    root = np.arange(n)
    full = linked | linked.T | np.eye(n, dtype=bool)
    while True:
        new = np.where(full, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new
