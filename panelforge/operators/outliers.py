"""Removal of whole series that are outliers in one period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.grouped import group_quantiles, group_sizes, lookup_join


def iqr_bounds(
    df: DataFrame, at: int, value: str, multiplier: float = 1.5, min_group_size: int = 5,
    zero_iqr_means_none: bool = True, entity: str = "entity", period: str = "period",
) -> DataFrame:
    """Per entity the quartiles at one period and the bounds, NULL where no bounds apply."""
    rows = df.where(F.col(period) == at)
    sizes = group_sizes(rows, [entity])
    q = group_quantiles(rows, [entity], value, (0.25, 0.75), sizes=sizes)
    iqr = F.col("q")[1] - F.col("q")[0]
    applies = F.col("n") >= min_group_size
    if zero_iqr_means_none:
        applies = applies & (iqr > 0)
    return q.select(
        entity, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"),
        F.when(applies, F.col("q")[0] - multiplier * iqr).alias("lower"),
        F.when(applies, F.col("q")[1] + multiplier * iqr).alias("upper"),
    )


def removed_series(
    df: DataFrame, at: int, value: str, multiplier: float = 1.5, min_group_size: int = 5,
    zero_iqr_means_none: bool = True, entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """The keys of the series whose value at the period is strictly outside the bounds; only that period is read."""
    bounds = iqr_bounds(df, at, value, multiplier, min_group_size, zero_iqr_means_none, entity, period)
    rows = lookup_join(df.where(F.col(period) == at).select(entity, future, value), bounds.select(entity, "lower", "upper"), [entity], "inner")
    return rows.where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))).select(entity, future).distinct()


def mark_outlier_series(df: DataFrame, at: int, value: str, **options) -> DataFrame:
    """Add ``is_outlier`` to every row of a removed series."""
    keys = [options.get("entity", "entity"), options.get("future", "future_id")]
    removed = removed_series(df, at, value, **options).withColumn("is_outlier", F.lit(True))
    return df.join(removed, keys, "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))


def remove_outlier_series(df: DataFrame, at: int, value: str, **options) -> DataFrame:
    """``df`` without the removed series. There are few of them, so the ensemble usually stays where it is."""
    keys = [options.get("entity", "entity"), options.get("future", "future_id")]
    return df.join(removed_series(df, at, value, **options), keys, "left_anti")
