"""Labels for futures: which of them count as vulnerable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import compare_close
from panelforge.operators.cleaning import reference_dimension
from panelforge.operators.grouped import GroupSizes, group_quantiles, group_sizes, lookup_join
from panelforge.operators.trajectory import pivot_periods


def indicator(condition: Column) -> Column:
    """1 when the condition holds, else 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def balancing_threshold(df: DataFrame, value: str, entity: str = "entity", sizes: GroupSizes | None = None) -> DataFrame:
    """Per entity the split point that best balances values above against the rest.

    Candidates are midpoints of adjacent sorted values, the smallest winning a tie. The imbalance
    ``abs(n - 2 C)`` is smallest next to the median, so only the values around it matter: the first
    value whose cumulative count reaches n/2 and the distinct value before it. Repeated values split
    at themselves. Falls back to the minimum when no candidate separates the values.
    """
    rows = df.where(F.col(value).isNotNull()).select(entity, F.col(value).cast("double").alias("_v"))
    sizes = sizes or group_sizes(df, [entity])
    per_value = rows.groupBy(entity, "_v").agg(F.count(F.lit(1)).alias("_c"))
    middle = group_quantiles(rows, [entity], "_v", [0.5], discrete=True, sizes=sizes).select(
        entity, "n", F.col("q")[0].alias("_m")
    )
    around = lookup_join(per_value, middle, [entity], "inner").groupBy(entity).agg(
        F.first("n").alias("n"), F.first("_m").alias("_m"), F.min("_v").alias("_min"),
        F.sum(F.when(F.col("_v") < F.col("_m"), F.col("_c")).otherwise(0)).alias("_below"),
        F.max(F.when(F.col("_v") == F.col("_m"), F.col("_c"))).alias("_at"),
        F.max(F.when(F.col("_v") < F.col("_m"), F.struct("_v", "_c"))).alias("_prev"),
        F.min(F.when(F.col("_v") > F.col("_m"), F.col("_v"))).alias("_next"),
    )
    first = F.when(F.col("_prev._c") > 1, F.col("_prev._v")).otherwise((F.col("_prev._v") + F.col("_m")) / 2.0)
    second = F.when(F.col("_at") > 1, F.col("_m")).otherwise((F.col("_m") + F.col("_next")) / 2.0)
    first_gap = F.when(F.col("_prev").isNotNull(), F.abs(F.col("n") - 2 * F.col("_below")))
    second_gap = F.when(F.col("_next").isNotNull(), F.abs(F.col("n") - 2 * (F.col("_below") + F.col("_at"))))
    best = (
        F.when(first_gap.isNotNull() & (second_gap.isNull() | (first_gap <= second_gap)), first)
        .when(second_gap.isNotNull(), second).otherwise(F.col("_min"))
    )
    return around.select(entity, best.alias("vulnerability_threshold"))


def label_futures(
    ensemble: DataFrame, value: str, start: int, end: int, auto_threshold: bool = False,
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """One row per future with both period values and ``vulnerability_indicator``.

    Without ``auto_threshold`` a future is vulnerable when it ends above its start, otherwise when it
    ends above its entity's balancing threshold.
    """
    wide = pivot_periods(ensemble, value, [start, end], entity, future, period)
    first, last = str(start), str(end)
    if not auto_threshold:
        return wide.withColumn("vulnerability_indicator", indicator(F.col(last) > F.col(first)))
    sizes = group_sizes(ensemble.where(F.col(period) == end), [entity])
    threshold = balancing_threshold(wide, last, entity, sizes)
    return lookup_join(wide, threshold, [entity]).withColumn(
        "vulnerability_indicator", indicator(F.col(last) > F.col("vulnerability_threshold"))
    ).select(entity, future, first, last, "vulnerability_threshold", "vulnerability_indicator")


def attach_caps(labelled: DataFrame, caps: DataFrame, cap: str, alias: str = "cap", order: Sequence[str] | None = None, entity: str = "entity") -> DataFrame:
    """Left join of one cap per entity, keys matched in upper case.

    ``order`` (file position, date) picks the row that counts where an entity has several; without it the caps hold one each.
    """
    dimension = reference_dimension(caps, entity, [cap], order)
    dimension = dimension.select(entity, F.col(cap).try_cast("double").alias(alias))
    return lookup_join(labelled.withColumn(entity, F.upper(entity)), dimension, [entity])


def join_summary(summary: DataFrame, labelled: DataFrame, entity: str = "entity", future: str = "future_id") -> DataFrame:
    """Trajectory summary with the labels of its futures; indicators stay integers."""
    flags = [c for c in labelled.columns if "indicator" in c]
    return summary.join(labelled, [entity, future], "left").withColumns({c: F.col(c).cast("int") for c in flags})


def single_value(c: str) -> Column:
    """A group's value when all its values agree within tolerance, else NULL."""
    lowest, highest = F.min(c), F.max(c)
    return F.when(F.abs(highest - lowest) <= 1e-8 + 1e-5 * F.abs(lowest), lowest)


def threshold_comparison(labelled: DataFrame, start: str, cap: str, entity: str = "entity") -> DataFrame:
    """Where each entity's threshold lies relative to its start value and its cap."""
    per_entity = labelled.groupBy(entity).agg(
        F.max("vulnerability_threshold").alias("vulnerability_threshold"),
        single_value(start).alias("_start"), single_value(cap).alias("_cap"),
    )
    return per_entity.select(
        entity, "vulnerability_threshold",
        compare_close("vulnerability_threshold", "_start").alias("threshold_vs_start"),
        compare_close("vulnerability_threshold", "_cap").alias("threshold_vs_cap"),
    )


def class_balance(labelled: DataFrame, label: str = "vulnerability_indicator", entity: str = "entity") -> DataFrame:
    """Rows per class and whether both classes occur."""
    counts = labelled.where(F.col(label).isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 0).alias("class_0"),
        F.count_if(F.col(label) == 1).alias("class_1"),
    )
    usable = (F.col("class_0") > 0) & (F.col("class_1") > 0)
    return counts.withColumn("status", F.when(usable, "both_classes").otherwise("one_class"))
