"""Hodrick-Prescott trend and cycle.

The trend of a series y solves ``(I + lambda D'D) trend = y`` with D the second difference. The system
has five diagonals, so a series of T points costs O(T). Series are gathered per key (at most one value
per period) and solved in Arrow batches: all series of a batch that share a length are swept together.

A series beyond ``max_series`` rows is cut into chunks. A chunk meets its neighbours only through the two trend values
before and the two after it, so its trend is a solution of its own plus four responses to these values. The first and last two values
of all chunks of a series form a small system; with its solution every chunk is solved once more, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.cleaning import numeric_columns
from panelforge.operators.grouped import row_index
from panelforge.operators.panel import _too_long, interpolate
from panelforge.session import staged


def _bands(start: int, count: int, length: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Main diagonal and the two upper diagonals of ``I + penalty * D'D`` for ``count`` rows from ``start`` on."""
    rows = start + np.arange(count)
    here, before, earlier = (((r >= 0) & (r <= length - 3)).astype(float) for r in (rows, rows - 1, rows - 2))
    return 1.0 + penalty * (here + 4.0 * before + earlier), -2.0 * penalty * (here + before), penalty * here


def _solve_bands(main: np.ndarray, first: np.ndarray, second: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of the banded system for the columns of ``right`` by LDL' elimination."""
    length = len(main)
    pivot, l1, l2 = np.empty(length), np.zeros(length), np.zeros(length)
    for i in range(length):
        pivot[i] = main[i]
        if i >= 1:
            off = first[i - 1] - (l1[i - 1] * second[i - 2] if i >= 2 else 0.0)
            l1[i] = off / pivot[i - 1]
            pivot[i] -= l1[i] * off
        if i >= 2:
            l2[i] = second[i - 2] / pivot[i - 2]
            pivot[i] -= l2[i] * second[i - 2]
    x = right.astype(float).copy()
    for i in range(1, length):
        x[i] -= l1[i] * x[i - 1]
        if i >= 2:
            x[i] -= l2[i] * x[i - 2]
    x /= pivot[:, None]
    for i in range(length - 2, -1, -1):
        x[i] -= l1[i + 1] * x[i + 1]
        if i + 2 < length:
            x[i] -= l2[i + 2] * x[i + 2]
    return x


def hp_trend_matrix(series: np.ndarray, penalty: float) -> np.ndarray:
    """Trends of many series of equal length (one per row)."""
    length = series.shape[1]
    return _solve_bands(*_bands(0, length, length, penalty), series.T).T


def hp_trend(values: Column | str, penalty: float = 100.0) -> Column:
    """Trend of an ``array<double>`` column without missing items."""

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            lengths = batch.map(lambda v: 0 if v is None else len(v))
            for length, index in lengths.groupby(lengths).groups.items():
                if length > 0:
                    trends = hp_trend_matrix(np.stack(batch.loc[index].to_numpy()), penalty)
                    out.loc[index] = pd.Series(list(trends), index=index)
            yield out

    return solve(F.col(values) if isinstance(values, str) else values)


# ---------------------------------------------------------------- series longer than a task

def _coupling(start: int, count: int, length: int, penalty: float) -> np.ndarray:
    """What each row of a chunk takes of the two values before and the two after it (zero at the ends of the series)."""
    out = np.zeros((count, 4))
    if count >= 4:  # a shorter chunk is a whole series
        _, first, second = _bands(start - 2, count + 2, length, penalty)
        out[0, 0], out[0, 1], out[1, 1] = second[0], first[1], second[1]
        out[-2, 2], out[-1, 2], out[-1, 3] = second[count], first[count + 1], second[count + 1]
    return out


def _interface(ends: np.ndarray, responses: np.ndarray) -> np.ndarray:
    """The two values before and after every chunk of one series, from each chunk's own end values and their responses.

    ``ends``: chunk x 4 (first two, last two); ``responses``: chunk x 4 x 4. Block elimination from the first chunk on.
    """
    count = len(ends)
    gain, rest = np.zeros((count, 4, 2)), np.zeros((count, 4))  # ends = rest - gain @ (first two of the next chunk)
    for k in range(count):
        system, right, ahead = np.eye(4), ends[k].copy(), responses[k][:, 2:]
        if k:
            system[:, :2] -= responses[k][:, :2] @ gain[k - 1][2:]
            right -= responses[k][:, :2] @ rest[k - 1][2:]
        solved = np.linalg.solve(system, np.column_stack([right, ahead]))
        rest[k], gain[k] = solved[:, 0], solved[:, 1:]
    values = np.zeros((count, 4))
    for k in range(count - 1, -1, -1):
        values[k] = rest[k] - (gain[k] @ values[k + 1][:2] if k + 1 < count else 0.0)
    around = np.zeros((count, 4))
    around[1:, :2], around[:-1, 2:] = values[:-1, 2:], values[1:, :2]
    return around


def _trend_in_chunks(df: DataFrame, y: str, output: str, keys: Sequence[str], period: str, penalty: float, min_len: int, max_series: int) -> DataFrame:
    """Add the trend of ``y`` over its known values as ``output``; no task holds more than ``max_series`` rows of a series."""
    size, columns = max(max_series // 2, 4), list(df.columns)
    placed = row_index(df.where(F.col(y).isNotNull()), [*keys, period], "_row")
    spans = placed.groupBy(*keys).agg(F.min("_row").alias("_series"), F.count(F.lit(1)).alias("_n")).toDF(*[f"_key{i}" for i in range(len(keys))], "_series", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    chunk = F.least(F.floor((F.col("_row") - F.col("_series")) / size), F.greatest(F.floor(F.col("_n") / size), F.lit(1)) - 1).alias("_chunk")
    located = placed.join(spans, reduce(Column.__and__, same) if same else F.lit(True)).select(*columns, "_row", "_series", "_n", chunk)
    gathered = located.where(F.col("_n") >= min_len).groupBy("_series", "_n", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_row", F.struct(*columns).alias("_own")))).alias("_rows"))
    chunks = staged(gathered.select("_series", "_n", "_chunk", (F.col("_rows")[0]["_row"] - F.col("_series")).alias("_from"), F.col("_rows._own").alias("_rows"), F.col(f"_rows._own.{y}").alias("_y")))

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for series, n, number, start, values in frame.itertuples(index=False):
                count = len(values)
                solved = _solve_bands(*_bands(start, count, n, penalty), np.column_stack([values, _coupling(start, count, n, penalty)]))[[0, 1, -2, -1]]
                rows.append((series, number, solved[:, 0], solved[:, 1:].ravel()))
            yield pd.DataFrame(rows, columns=["_series", "_chunk", "_ends", "_responses"])

    def around(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_chunk")
        found = _interface(np.stack(frame["_ends"]), np.stack(frame["_responses"]).reshape(-1, 4, 4))
        return pd.DataFrame({"_series": frame["_series"], "_chunk": frame["_chunk"], "_around": list(found)})

    numbers = chunks.where(F.col("_n") >= 2 * size).select("_series", "_n", "_chunk", "_from", "_y")
    reduced = numbers.mapInPandas(ends, "_series long, _chunk long, _ends array<double>, _responses array<double>")
    neighbours = reduced.groupBy("_series").applyInPandas(around, "_series long, _chunk long, _around array<double>")

    @F.pandas_udf("array<double>")
    def solve(values: pd.Series, start: pd.Series, length: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for v, a, n, near_v in zip(values, start, length, near):
            right = np.asarray(v, dtype=float) - (0.0 if near_v is None else _coupling(a, len(v), n, penalty) @ near_v)
            out.append(_solve_bands(*_bands(a, len(v), n, penalty), right[:, None])[:, 0])
        return pd.Series(out)

    trends = chunks.join(neighbours, ["_series", "_chunk"], "left").select(F.arrays_zip("_rows", solve("_y", "_from", "_n", "_around").alias("_trend")).alias("_both"))
    known = trends.select(F.explode("_both").alias("_one")).select(*[F.col("_one._rows")[c].alias(c) for c in columns], F.col("_one._trend").alias(output))
    none = F.lit(None).cast("double").alias(output)
    short = located.where(F.col("_n") < min_len).select(*columns, none)
    return known.unionByName(short).unionByName(df.where(F.col(y).isNull()).select(*columns, none))


def hp_filter(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = ("entity",),
    period: str = "period",
    penalty: float = 100.0,
    which: str = "trend",
    min_len: int = 6,
    interpolate_missing: bool = True,
    keep: str = "both",
    suffix: str | None = None,
    max_series: int | None = None,
) -> DataFrame:
    """Add ``<column>_hp_trend`` or ``<column>_hp_cycle`` for every series given by ``keys``.

    Missing values are interpolated first; series with fewer than ``min_len`` values get NULL. Without
    interpolation a series with missing values is filtered over its known values only.
    ``keep``: "both" keeps the inputs, "filtered_only" drops them, "replace" overwrites them. With ``max_series`` longer series
    are filtered in chunks, with the same result.
    """
    if which not in ("trend", "cycle"):
        raise ValueError("which must be 'trend' or 'cycle'")
    if keep not in ("both", "filtered_only", "replace"):
        raise ValueError("keep must be 'both', 'filtered_only' or 'replace'")
    keys = list(keys)
    columns = list(columns) if columns is not None else numeric_columns(df, [*keys, period])
    work = [f"_y_{c}" for c in columns]
    base = df.withColumns({y: F.col(c).cast("double") for y, c in zip(work, columns)})
    if interpolate_missing:
        base = interpolate(base, work, keys, period, max_series)
    name = "" if keep == "replace" else (suffix or f"_hp_{which}")
    if _too_long(df, keys, max_series):
        rows = base
        for y in work:
            rows = _trend_in_chunks(rows, y, f"_t{y}", keys, period, penalty, min_len, max_series)
        filtered = {f"{c}{name}": F.col(f"_t{y}") if which == "trend" else F.col(y) - F.col(f"_t{y}") for c, y in zip(columns, work)}
        out = rows.withColumns(filtered).drop(*work, *[f"_t{y}" for y in work])
        return out.drop(*columns) if keep == "filtered_only" else out
    so_far = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumns({f"_k{y}": F.count(y).over(so_far) for y in work})
    rest = [c for c in base.columns if c not in keys and c != period]
    series = base.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(period, *rest))).alias("_rows"))
    trends = {}
    for y in work:
        known = F.expr(f"transform(filter(_rows, r -> r.`{y}` is not null), r -> r.`{y}`)")
        trends[f"_t{y}"] = hp_trend(F.when(F.size(known) >= min_len, known), penalty)
    rows = series.withColumns(trends).withColumn("_row", F.explode("_rows")).select(
        *keys, *trends, F.col(f"_row.{period}").alias(period), *[F.col(f"_row.{c}").alias(c) for c in rest]
    )
    filtered = {}
    for c, y in zip(columns, work):
        trend = F.when(F.col(y).isNotNull(), F.get(f"_t{y}", F.col(f"_k{y}") - 1))
        filtered[f"{c}{name}"] = trend if which == "trend" else F.col(y) - trend
    out = rows.withColumns(filtered).drop(*trends, *work, *[f"_k{y}" for y in work])
    return out.drop(*columns) if keep == "filtered_only" else out
