"""Batch reports and the tables behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import parse_list, slugify
from panelforge.operators.grouped import lookup_join

UNCLASSIFIED = "unclassified"


def successful_members(summary: DataFrame, income: DataFrame, item: Column, entity: str = "entity") -> DataFrame:
    """Long report: one row per (item, income group, entity) of successful runs.

    ``item`` is an array column expression; NULL groups become ``unclassified``.
    """
    rows = summary.where(F.col("status") == "success").select(F.upper(entity).alias(entity), F.explode(item).alias("item"))
    groups = income.select(F.upper(entity).alias(entity), "income_group")
    return lookup_join(rows, groups, [entity]).withColumn("income_group", F.coalesce("income_group", F.lit(UNCLASSIFIED)))


def frequency_report(members: DataFrame, income_groups: Sequence[str], name: str, entity: str = "entity", list_cells: bool = False) -> DataFrame:
    """Count per item and income group; with ``list_cells`` the bar-joined sorted entities in place of the group counts.

    A list cell gathers its entities in one row, so it is made on request only; the long report
    (:func:`successful_members`) holds the same entities one per row.
    """

    def listed(group: str) -> Column:
        if not list_cells:
            return F.count_if(F.col("income_group") == group).alias(f"{slugify(group)}_count")
        own = F.collect_list(F.when(F.col("income_group") == group, F.col(entity)))
        return F.array_join(F.sort_array(own), "|").alias(f"{slugify(group)}_entities")

    return members.groupBy(F.col("item").alias(name)).agg(
        F.count(F.lit(1)).alias("count"), *[listed(g) for g in [*sorted(income_groups), UNCLASSIFIED]]
    ).orderBy(F.desc("count"), name)


def driver_frequency(summary: DataFrame, income: DataFrame, income_groups: Sequence[str], drivers: str = "selected_top_features", entity: str = "entity", list_cells: bool = False) -> DataFrame:
    """How often each driver was selected."""
    return frequency_report(successful_members(summary, income, parse_list(drivers), entity), income_groups, "feature", entity, list_cells)


def combination_frequency(summary: DataFrame, income: DataFrame, income_groups: Sequence[str], drivers: str = "selected_top_features", entity: str = "entity", list_cells: bool = False) -> DataFrame:
    """How often each set of drivers was selected, whatever their order."""
    items = F.array_sort(parse_list(drivers))
    combination = F.when(F.size(items) > 0, F.array(F.array_join(items, "|")))
    return frequency_report(successful_members(summary, income, combination, entity), income_groups, "feature_combination", entity, list_cells)


def figure_trajectories(
    ensemble: DataFrame, history: DataFrame, caps: DataFrame, value: str, entities: DataFrame, cap_columns: Sequence[str],
    entity: str = "entity", future: str = "future_id", period: str = "period",
) -> DataFrame:
    """Tidy table of one figure: futures, history and cap lines of the chosen entities."""
    chosen = entities.select(entity).distinct()
    none = F.lit(None)
    paths = lookup_join(ensemble, chosen, [entity], "left_semi").select(
        entity, F.lit("future").alias("kind"), F.col(future).alias("series"), F.col(period).alias("period"), F.col(value).alias("value")
    )
    past = lookup_join(history, chosen, [entity], "left_semi").select(
        entity, F.lit("history").alias("kind"), none.cast("string").alias("series"), F.col(period).alias("period"), F.col(value).alias("value")
    )
    lines = lookup_join(caps, chosen, [entity], "left_semi").select(entity, *cap_columns).unpivot([entity], list(cap_columns), "series", "value")
    lines = lines.where("value is not null").select(
        entity, F.lit("cap").alias("kind"), "series", none.cast("int").alias("period"), "value"
    )
    return paths.unionByName(past).unionByName(lines)


def figure_distribution(labelled: DataFrame, end: str, reference: str, bins: int = 30, entity: str = "entity") -> DataFrame:
    """Histogram of end values per entity with the entity's reference value on every row."""
    rows = labelled.where(F.col(end).isNotNull())
    ends = rows.groupBy(entity).agg(
        F.min(end).alias("_lo"), F.max(end).alias("_hi"), F.min(reference).alias("_ref_min"), F.max(reference).alias("_ref_max")
    )
    same = F.abs(F.col("_ref_max") - F.col("_ref_min")) <= 1e-8 + 1e-5 * F.abs("_ref_min")
    joined = lookup_join(rows.select(entity, F.col(end).alias("_v")), ends, [entity], "inner")
    offset = F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))
    bin_no = F.least(F.floor(F.coalesce(offset, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return joined.groupBy(entity, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.first(F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * bin_no).alias("bin_start"),
        F.first(F.when(same, F.col("_ref_min"))).alias("reference"),
    )


def figure_box_points(members: DataFrame, drivers: int, entity: str = "entity", future: str = "future_id") -> DataFrame:
    """Every pair of driver axes with the futures' values, label and box membership."""
    pairs = [(i, j) for i in range(drivers) for j in range(i + 1, drivers)] or [(0, 0)]
    views = F.array(*[
        F.struct(F.lit(i).alias("x_slot"), F.lit(j).alias("y_slot"), F.col(f"value_{i}").alias("x"), F.col(f"value_{j}").alias("y"))
        for i, j in pairs
    ])
    return members.select(entity, future, "label", "in_box", F.inline(views)).where("x is not null and y is not null")


def points_by_class(df: DataFrame, x: str, y: str, label: str, entity: str = "entity", future: str = "future_id") -> DataFrame:
    return df.na.drop(how="any", subset=[x, y, label]).select(entity, future, F.col(x).alias("x"), F.col(y).alias("y"), F.col(label).alias("label"))
