"""Calibration of simulated series to observed base-period values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.grouped import keep_first, lookup_join

METHODS = ("additive", "multiplicative")


def base_value(column: str, base: int, keys: Sequence[str], period: str) -> Column:
    """The series' own value at the base period, attached to each of its rows."""
    return F.max(F.when(F.col(period) == base, F.col(column))).over(Window.partitionBy(*keys))


def calibrated(value: Column, own_base: Column, observed: Column, method: str) -> Column:
    """additive: observed + (value - base); multiplicative: observed * value / base, NULL for a zero base."""
    if method == "additive":
        return observed + (value - own_base)
    if method == "multiplicative":
        return observed * F.try_divide(value, own_base)
    raise ValueError(f"method must be one of {METHODS}, got {method!r}")


def calibrate(
    simulated: DataFrame,
    initial: DataFrame,
    base: int,
    columns: Sequence[str] | None = None,
    column_map: Mapping[str, str] | None = None,
    method: str | Mapping[str, str] = "multiplicative",
    update_logs: bool = True,
    order: Sequence[str] | None = None,
    log_prefix: str = "log_",
    entity: str = "entity",
    future: str = "future_id",
    period: str = "period",
) -> DataFrame:
    """Make each future start from the observed base-period values and carry the deviation forward.

    ``column_map`` maps columns of ``initial`` to columns of ``simulated``; by default all shared
    columns. A log column present in ``simulated`` is refreshed from its calibrated level. The base
    value comes from a window over the series, so the ensemble is shuffled once and never self-joined.
    ``initial`` holds one row per entity at the base period; where it has several, ``order`` picks the first.
    """
    if column_map is None:
        shared = columns if columns is not None else [
            c for c in initial.columns if c not in (entity, period) and c in simulated.columns
        ]
        column_map = {c: c for c in shared}
    pairs = {i: s for i, s in column_map.items() if i in initial.columns and s in simulated.columns}
    if not pairs:
        return simulated
    observed = initial.where(F.col(period) == base) if period in initial.columns else initial
    if order:
        observed = keep_first(observed.select(entity, *pairs, *[F.col(o).alias(f"_order_{i}") for i, o in enumerate(order)]), [entity], [f"_order_{i}" for i in range(len(order))])
    observed = observed.select(entity, *[F.col(i).cast("double").alias(f"_o_{i}") for i in pairs])
    keys = [entity, future]
    out = lookup_join(simulated, observed, [entity]).withColumns(
        {f"_b_{s}": base_value(s, base, keys, period) for s in pairs.values()}
    )
    chosen = {i: method if isinstance(method, str) else method.get(i, "multiplicative") for i in pairs}
    out = out.withColumns({
        s: calibrated(F.col(s), F.col(f"_b_{s}"), F.col(f"_o_{i}"), chosen[i]) for i, s in pairs.items()
    })
    if update_logs:
        logs = {f"{log_prefix}{s}": s for s in pairs.values() if not s.startswith(log_prefix)}
        out = out.withColumns({
            log: F.when(F.col(s) > 0, F.ln(s)) for log, s in logs.items() if log in simulated.columns
        })
    return out.select(*simulated.columns)
