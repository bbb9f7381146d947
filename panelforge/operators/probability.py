"""Share of futures that meet a cap, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import clean_number
from panelforge.operators.grouped import (
    group_quantiles,
    group_sizes,
    keep_first,
    lookup_join,
)
from panelforge.session import staged


def caps_from_base(
    reference: DataFrame, history: DataFrame, base: int, log_value: str, reductions: dict[str, str],
    base_alias: str = "base_value", entity: str = "entity", period: str = "period",
) -> DataFrame:
    """Absolute caps ``(1 + reduction) * base value`` for every entity with a base-period value.

    ``reductions`` maps output column -> column of relative change; the base value is ``expm1`` of the
    stored log value. Entities without a reference row stay, with NULL caps.
    """
    at_base = history.where(F.col(period) == base).select(entity, F.expm1(log_value).alias(base_alias))
    joined = lookup_join(at_base, reference, [entity])
    return joined.withColumns({out: (1.0 + F.col(r)) * F.col(base_alias) for out, r in reductions.items()})


def evaluated_futures(
    ensemble: DataFrame, caps: DataFrame, at: int, value: str, cap_columns: Sequence[str],
    cap_order: Sequence[str] | None = None, entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """Target-period rows with a value and at least one cap, caps attached.

    Without ``cap_order`` the caps hold one row per entity. With it an entity's first row in that order (file position, date)
    counts, whatever its values: a first row without a cap leaves the entity without one.
    """
    clean = caps.select(entity, *[clean_number(c).alias(c) for c in cap_columns], *[F.col(o).alias(f"_order_{i}") for i, o in enumerate(cap_order or [])])
    if cap_order:
        clean = keep_first(clean, [entity], [f"_order_{i}" for i in range(len(cap_order))])
    one_per_entity = clean.select(entity, *cap_columns)
    rows = ensemble.where(F.col(period) == at).select(entity, future, clean_number(value).alias(value))
    joined = lookup_join(rows.where(F.col(value).isNotNull()), one_per_entity, [entity])
    return joined.where(F.coalesce(*cap_columns).isNotNull())


def cap_share(
    ensemble: DataFrame, caps: DataFrame, at: int, value: str, cap_columns: Sequence[str],
    keep_caps: bool = False, cap_order: Sequence[str] | None = None,
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """Per entity the number of futures and the share strictly below each cap (NULL for a missing cap).

    An ensemble has one row per (entity, future, period), so the futures of a period are counted as they come.
    """
    rows = evaluated_futures(ensemble, caps, at, value, cap_columns, cap_order, entity, future, period)
    meets = [F.avg((F.col(value) < F.col(c)).cast("int")).alias(f"meets_{c}") for c in cap_columns]
    kept = [F.first(c).alias(f"cap_{c}") for c in cap_columns] if keep_caps else []
    return rows.groupBy(entity).agg(F.count(future).alias("n_futures"), *meets, *kept)


def q1_mean(
    ensemble: DataFrame, at: int, value: str, alias: str = "q1_mean",
    entity: str = "entity", period: str = "period",
) -> DataFrame:
    """Mean of the values at or below the entity's 25th percentile in one period."""
    at_period = ensemble.where(F.col(period) == at)
    sizes = group_sizes(at_period, [entity])
    rows = at_period.select(entity, clean_number(value).alias("_x")).where("_x is not null")
    cut = group_quantiles(rows, [entity], "_x", [0.25], sizes=sizes).select(entity, F.col("q")[0].alias("_q1"))
    low = F.when(F.col("_x") <= F.col("_q1"), F.col("_x"))
    return lookup_join(rows, cut, [entity], "inner").groupBy(entity).agg(F.avg(low).alias(alias))


def probability_table(
    ensemble: DataFrame, caps: DataFrame, at: int, value: str, cap_columns: Sequence[str],
    stage: Callable[[DataFrame], DataFrame] = staged,
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """Shares, caps and lower-quartile mean side by side, one row per evaluated entity.

    Shares, quartiles and means all read the target period only, so that slice is written once by
    ``stage``; pass ``lambda df: df`` when the ensemble is a stored table already.
    """
    slice_ = stage(ensemble.where(F.col(period) == at).select(entity, future, period, value))
    shares = cap_share(slice_, caps, at, value, cap_columns, entity=entity, future=future, period=period)
    low = q1_mean(slice_, at, value, entity=entity, period=period)
    return shares.join(caps, entity, "left").join(low, entity, "left")


def headline(table: DataFrame, probability: str, threshold: float = 0.5, entity: str = "entity") -> DataFrame:
    """Number and percent of entities whose probability exceeds the threshold."""
    above = F.count_distinct(F.when(F.col(probability) > threshold, F.col(entity)))
    total = F.count_distinct(entity)
    return table.agg(
        total.alias("n_entities"), above.alias("n_above"), (F.try_divide(above, total) * 100.0).alias("pct_above")
    )


def exceedance_curve(table: DataFrame, probability: str, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Share of entities with a probability >= each threshold (200 points on [0, 1] by default).

    Every row is reduced to the number of thresholds it reaches; the curve is the reverse running sum
    over that small histogram, so rows are never multiplied by thresholds.
    """
    points = [float(t) for t in (np.linspace(0.0, 1.0, 200) if thresholds is None else sorted(thresholds))]
    grid = F.array(*[F.lit(t) for t in points])
    reached: Column = F.size(F.filter(grid, lambda t: t <= F.col(probability)))
    counts = (
        table.where(F.col(probability).isNotNull()).groupBy(reached.alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
        .agg(F.map_from_entries(F.collect_list(F.struct("_k", "_c"))).alias("_m"), F.sum("_c").alias("_n"))
    )
    items = F.transform(grid, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    reaching = F.aggregate(
        F.map_entries("_m"), F.lit(0).cast("bigint"),
        lambda acc, e: acc + F.when(e["key"] > F.col("i"), e["value"]).otherwise(0),
    )
    return (
        counts.select("_m", "_n", F.inline(items))
        .select(F.col("i").alias("step"), F.col("t").alias("threshold"), F.try_divide(reaching, F.col("_n")).alias("share"))
    )

