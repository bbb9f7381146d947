"""Summaries of one future's trajectory: a single aggregate over all futures of all entities.

An ensemble has one row per (entity, future, period), so periods are counted as they come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalar import pct_change
from panelforge.operators.rules import Rulebook

# Statistics kept for each category in the full summary.
FULL_STATS = {
    "binary": ("mean", "last", "max", "switches"),
    "cumulative_binary": ("last", "max"),
    "count": ("sum", "mean", "std", "max", "last", "delta", "slope"),
    "cumulative_count": ("last", "max", "delta", "slope"),
}
OTHER_STATS = ("mean", "std", "min", "max", "last", "delta", "slope")


def _statistic(name: str, c: str, period: str) -> Column:
    value = F.col(c).cast("double")
    at = F.when(F.col(c).isNotNull(), F.col(period))
    if name == "delta":
        return F.max_by(value, at) - F.min_by(value, at)
    if name == "slope":
        return F.regr_slope(value, F.when(F.col(c).isNotNull(), F.col(period).cast("double")))
    if name == "switches":
        return F.when(F.count(c) > 0, F.coalesce(F.sum(F.abs(f"_step_{c}")), F.lit(0.0)))
    return {
        "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value),
        "last": F.max_by(value, at), "sum": F.sum(value),
    }[name]


def summarize_full(
    ensemble: DataFrame, columns: Sequence[str], rules: Rulebook,
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """Category-specific statistics ``<column>__<stat>`` per future."""
    stats = {c: FULL_STATS.get(rules.category(c, inherit_signed_log=False), OTHER_STATS) for c in columns}
    stepped = [c for c in columns if "switches" in stats[c]]
    rows = ensemble
    if stepped:
        before = Window.partitionBy(entity, future).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"_step_{c}": F.col(c) - F.last(c, ignorenulls=True).over(before) for c in stepped})
    return rows.groupBy(entity, future).agg(
        F.min(period).alias("period_start"), F.max(period).alias("period_end"),
        F.count(period).alias("n_periods"),
        *[_statistic(s, c, period).alias(f"{c}__{s}") for c in columns for s in stats[c]],
    )


def summarize_change(
    ensemble: DataFrame, columns: Sequence[str], rules: Rulebook, start: int, end: int,
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """Start, last, delta and relative (or, for 0/1 kinds, absolute) change between two periods."""
    at = {"start": start, "last": end}
    ends = ensemble.groupBy(entity, future).agg(
        F.count(period).alias("n_periods"),
        *[F.max(F.when(F.col(period) == t, F.col(c).cast("double"))).alias(f"_{k}_{c}") for c in columns for k, t in at.items()],
    )
    out = [F.lit(start).alias("period_start"), F.lit(end).alias("period_end"), F.col("n_periods")]
    for c in columns:
        both = F.col(f"_start_{c}").isNotNull() & F.col(f"_last_{c}").isNotNull()
        s, e = F.when(both, F.col(f"_start_{c}")), F.when(both, F.col(f"_last_{c}"))
        zero_one = rules.category(c, inherit_signed_log=False) in ("binary", "cumulative_binary")
        out += [
            s.alias(f"{c}__start"), e.alias(f"{c}__last"), (e - s).alias(f"{c}__delta"),
            (e - s).alias(f"{c}__change") if zero_one else pct_change(s, e).alias(f"{c}__pct_change"),
        ]
    return ends.select(entity, future, *out)


def summarize(ensemble: DataFrame, columns: Sequence[str], rules: Rulebook, mode: str = "full", start: int | None = None, end: int | None = None, **names) -> DataFrame:
    if mode == "full":
        return summarize_full(ensemble, columns, rules, **names)
    if mode == "pct_change":
        return summarize_change(ensemble, columns, rules, start, end, **names)
    raise ValueError(f"no trajectory summary is called {mode!r}; there are 'full' and 'pct_change'")


def pivot_periods(
    ensemble: DataFrame, value: str, periods: Sequence[int],
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """One row per future, one column per listed period."""
    return ensemble.groupBy(entity, future).agg(
        *[F.max(F.when(F.col(period) == t, F.col(value))).alias(str(t)) for t in periods]
    )
