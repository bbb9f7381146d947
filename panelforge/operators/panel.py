"""Time-series features on panels.

A panel has one row per ``(entity, period)``. Windows by entity therefore hold at most one row per
period of the calendar, however much raw data an entity owned before it was aggregated to periods.
All features of one call share a single window specification, hence one shuffle and one sort.

For panels with very long series, ``max_series`` names the rows of one series a task may hold. Longer
ones are then cut into consecutive chunks that are processed apart, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.grouped import group_sizes, row_index


def _ordered(keys: Sequence[str], period: str):
    return Window.partitionBy(*keys).orderBy(period)


def _too_long(df: DataFrame, keys: Sequence[str], max_series: int | None) -> bool:
    return max_series is not None and group_sizes(df, keys).largest > max_series


def _with_lookback(
    df: DataFrame, keys: Sequence[str], period: str, reach: int, max_series: int | None,
    build: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Apply ``build(frame, window keys)``, whose windows look back at most ``reach`` rows.

    In chunks, each one also gets copies of the ``reach`` rows before it, dropped again afterwards.
    """
    keys = list(keys)
    if not _too_long(df, keys, max_series):
        return build(df, keys)
    size = max(max_series, reach)
    chunk = F.floor(F.col("_row") / size)
    own, copy = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_copy")), F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_copy"))
    homes = F.when(F.col("_row") % size >= size - reach, F.array(own, copy)).otherwise(F.array(own))
    spread = row_index(df, [*keys, period], "_row").select("*", F.inline(homes))
    return build(spread, [*keys, "_chunk"]).where(~F.col("_copy")).drop("_row", "_chunk", "_copy")


def _neighbours(df: DataFrame, columns: Sequence[str], keys: Sequence[str], period: str, max_series: int | None) -> DataFrame:
    """Add position ``_pos`` and, per column, the nearest known ``(p, v)`` at or before (``_b_``) and at or
    after (``_a_``) each row. Chunks take over the last and next known values of their neighbours.
    """
    keys = list(keys)
    chunked = _too_long(df, keys, max_series)
    if chunked:
        out = row_index(df, [*keys, period], "_pos").withColumn("_chunk", F.floor(F.col("_pos") / max_series))
    else:
        out = df.withColumn("_pos", F.row_number().over(_ordered(keys, period)))
    inner = [*keys, "_chunk"] if chunked else keys
    w = _ordered(inner, period)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("v")))

    near = {}
    for c in columns:
        near[f"_b_{c}"] = F.last(known(c), ignorenulls=True).over(back)
        near[f"_a_{c}"] = F.first(known(c), ignorenulls=True).over(ahead)
    found = out.withColumns(near)
    if not chunked:
        return found
    over = Window.partitionBy(*keys).orderBy("_chunk")
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    ends = out.groupBy(*inner).agg(*[f(known(c)).alias(f"{n}{c}") for c in columns for f, n in ((F.max, "_l_"), (F.min, "_f_"))])
    carried = ends.select(*inner, *[
        e.alias(n) for c in columns for e, n in (
            (F.last(f"_l_{c}", ignorenulls=True).over(earlier), f"_cb_{c}"), (F.first(f"_f_{c}", ignorenulls=True).over(later), f"_ca_{c}"),
        )
    ])
    joined = found.join(carried, inner, "left")
    filled = {f"_{k}_{c}": F.coalesce(f"_{k}_{c}", f"_c{k}_{c}") for c in columns for k in "ba"}
    return joined.withColumns(filled).drop("_chunk", *[f"_c{k}_{c}" for c in columns for k in "ba"])


def _drop_neighbours(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop("_pos", *[f"_{k}_{c}" for c in columns for k in "ba"])


def add_lags(
    df: DataFrame, columns: Sequence[str], max_lag: int = 3, entity: str = "entity", period: str = "period", max_series: int | None = None,
) -> DataFrame:
    def build(frame: DataFrame, keys: list[str]) -> DataFrame:
        w = _ordered(keys, period)
        return frame.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, max_lag + 1)})

    return _with_lookback(df, [entity], period, max_lag, max_series, build)


def add_growth(df: DataFrame, columns: Sequence[str], entity: str = "entity", period: str = "period", max_series: int | None = None) -> DataFrame:
    """Period-on-period growth; a missing value first takes the entity's last known value."""
    padded = _neighbours(df, columns, [entity], period, max_series).withColumns({f"_f_{c}": F.col(f"_b_{c}.v") for c in columns})

    def build(frame: DataFrame, keys: list[str]) -> DataFrame:
        w = _ordered(keys, period)
        return frame.withColumns({
            f"{c}_growth_rate": F.try_divide(F.col(f"_f_{c}"), F.lag(f"_f_{c}").over(w)) - 1.0 for c in columns
        })

    kept = _drop_neighbours(padded, columns)
    return _with_lookback(kept, [entity], period, 1, max_series, build).drop(*[f"_f_{c}" for c in columns])


def rolling_features(
    df: DataFrame,
    slopes: dict[str, dict] | None = None,
    stds: dict[str, dict] | None = None,
    differences: dict[str, tuple[str, str]] | None = None,
    keys: Sequence[str] = ("entity",),
    period: str = "period",
    max_series: int | None = None,
) -> DataFrame:
    """Rolling OLS slopes, rolling sample stds and differences of such features.

    A feature spec is ``{"source": column, "window": w, "min_periods": m, "shift": s}``. The slope runs
    over row positions; ``shift`` moves the result down so that a row sees earlier periods only.
    """
    slopes, stds, differences = slopes or {}, stds or {}, differences or {}
    specs = {**slopes, **stds}
    reach = max((s["window"] + s.get("shift", 1) for s in specs.values()), default=1)

    def build(frame: DataFrame, window_keys: list[str]) -> DataFrame:
        w = _ordered(window_keys, period)
        out = frame.withColumn("_pos", F.row_number().over(w))

        def rows(spec: dict):
            return w.rowsBetween(-(spec["window"] - 1), 0)

        def enough(spec: dict, value: Column) -> Column:
            needed = max(spec.get("min_periods", spec["window"]), 2)
            return F.when(F.count(spec["source"]).over(rows(spec)) >= needed, value)

        raw = {
            **{f"_r_{n}": enough(s, F.regr_slope(s["source"], "_pos").over(rows(s))) for n, s in slopes.items()},
            **{f"_r_{n}": enough(s, F.stddev_samp(s["source"]).over(rows(s))) for n, s in stds.items()},
        }
        shifted = {
            n: F.lag(f"_r_{n}", s.get("shift", 1)).over(w) if s.get("shift", 1) > 0 else F.col(f"_r_{n}") for n, s in specs.items()
        }
        return out.withColumns(raw).withColumns(shifted).drop("_pos", *raw)

    out = _with_lookback(df, keys, period, reach, max_series, build)
    return out.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in differences.items()}) if differences else out


def complete_periods(df: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """Add the missing periods between each entity's first and last one, with NULL measures."""
    span = df.groupBy(entity).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    grid = span.select(entity, F.explode(F.sequence("_lo", "_hi")).alias(period))
    return grid.join(df, [entity, period], "left")


def interpolate(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("entity",), period: str = "period", max_series: int | None = None,
) -> DataFrame:
    """Linear interpolation over row positions; edges take the nearest known value."""
    out = _neighbours(df, columns, keys, period, max_series)
    filled = {}
    for c in columns:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        inner = b["v"] + (a["v"] - b["v"]) * F.try_divide(F.col("_pos") - b["p"], a["p"] - b["p"])
        filled[c] = F.coalesce(F.col(c).cast("double"), inner, b["v"], a["v"])
    return _drop_neighbours(out.withColumns(filled), columns)


def fill_within_group(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("entity",), period: str = "period", max_series: int | None = None,
) -> DataFrame:
    """Forward then backward fill inside the group; a group without any value stays NULL."""
    out = _neighbours(df, columns, keys, period, max_series)
    return _drop_neighbours(out.withColumns({c: F.coalesce(F.col(f"_b_{c}.v"), F.col(f"_a_{c}.v")) for c in columns}), columns)


def value_at_period(df: DataFrame, columns: Sequence[str], at: int, entity: str = "entity", period: str = "period") -> DataFrame:
    """Per entity the value at a period, else its last known value."""
    def pick(c: str) -> Column:
        known = F.when(F.col(c).isNotNull(), F.col(period))
        return F.coalesce(F.max(F.when(F.col(period) == at, F.col(c))), F.max_by(c, known)).alias(c)

    return df.groupBy(entity).agg(*[pick(c) for c in columns])


def differences(df: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in specs.items()})
