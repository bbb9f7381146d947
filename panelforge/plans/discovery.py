"""Scenario discovery for all entities in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import ordered_union
from panelforge.operators import boxes, drivers, reports, vulnerability
from panelforge.operators.rules import Rulebook
from panelforge.operators.trajectory import summarize
from panelforge.session import staged

LABEL = "vulnerability_indicator"
# Why an entity could not be analysed.
NO_FUTURES, NO_END = "entity has no futures", "no future reaches the end period"
ONE_LABEL, NO_DRIVERS, NO_BOXES = "all futures carry one label", "no driver could be ranked", "complete futures carry one label"


@dataclass(frozen=True)
class DiscoveryConfig:
    value: str
    start: int
    end: int
    rules: Rulebook
    mode: str = "pct_change"
    auto_threshold: bool = True
    top_k: int = 3
    extra_features: Sequence[str] = ()
    excluded: Sequence[str] = ()
    quantile_levels: Sequence[float] = tuple(boxes.levels())
    min_density: float = 0.60
    min_coverage: float = 0.60


@dataclass(frozen=True)
class DiscoveryResult:
    """Tables of one batch: labels and summary per future, then per entity the drivers and boxes."""

    merged: DataFrame
    importance: DataFrame
    selected_drivers: DataFrame
    box_input: DataFrame
    pareto: DataFrame
    run_summary: DataFrame


def features_of(merged: DataFrame) -> list[str]:
    return [c for c in merged.columns if "__" in c]


def merge_futures(projected: DataFrame, ensemble: DataFrame, config: DiscoveryConfig, caps: DataFrame | None = None, cap: str = "cap") -> DataFrame:
    """Trajectory summary of every future with its label (and its entity's cap)."""
    labelled = vulnerability.label_futures(projected, config.value, config.start, config.end, config.auto_threshold)
    if caps is not None:
        labelled = vulnerability.attach_caps(labelled, caps, cap)
    columns = [c for c in ensemble.columns if c not in ("entity", "future_id", "period", config.value, *config.excluded)]
    summary = summarize(ensemble, columns, config.rules, config.mode, **({"start": config.start, "end": config.end} if config.mode == "pct_change" else {}))
    return vulnerability.join_summary(summary, labelled)


def choose_drivers(importance: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Per entity its top drivers in order, with the extra features appended: ``drivers`` array."""
    ranked = drivers.top_drivers(importance, config.top_k).groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "driver"))), lambda x: x["driver"]).alias("top")
    )
    extra = F.array(*[F.lit(f) for f in config.extra_features]) if config.extra_features else F.array().cast("array<string>")
    return ranked.withColumn("drivers", ordered_union("top", extra))


def search_boxes(box_input: DataFrame, slots: int, config: DiscoveryConfig) -> DataFrame:
    """Non-dominated boxes with cutoffs, the best one marked; large grids are searched from coarse to fine."""
    sides = boxes.cutoffs(box_input, config.quantile_levels)
    if len(config.quantile_levels) ** slots > boxes.WHOLE_GRID:
        sides = staged(sides, name="box-sides")
        skyline = boxes.skyline_search(box_input, slots, config.quantile_levels, sides)
    else:
        skyline = boxes.pareto(boxes.grid_search(box_input, slots, config.quantile_levels, sides), slots)
    best = boxes.select_best(skyline, slots, min_density=config.min_density, min_coverage=config.min_coverage)
    return boxes.with_cutoffs(best, sides, config.quantile_levels, slots)


def discover(
    projected: DataFrame, ensemble: DataFrame, config: DiscoveryConfig, requested: DataFrame | None = None, caps: DataFrame | None = None,
    stage: Callable[[DataFrame], DataFrame] = staged,
) -> DiscoveryResult:
    """Label, summarize, rank drivers and search boxes; the entity is a key, not a loop variable.

    ``stage`` writes the two tables that several later steps read. ``requested`` lists the entities to
    report on; entities that cannot be analysed get an error row instead of stopping the batch.
    """
    if requested is not None:
        wanted = requested.select("entity").distinct()
        projected, ensemble = projected.join(wanted, "entity", "left_semi"), ensemble.join(wanted, "entity", "left_semi")
    merged = stage(merge_futures(projected, ensemble, config, caps))
    importance = drivers.driver_gini(merged, features_of(merged))
    chosen = stage(choose_drivers(importance, config))
    box_input = boxes.entity_box_input(merged, chosen)
    slots = config.top_k + len(config.extra_features)
    pareto = stage(search_boxes(box_input, slots, config))
    summary = run_summary(merged, chosen, pareto, config, requested if requested is not None else projected.select("entity").distinct())
    return DiscoveryResult(merged, importance, chosen, box_input, pareto, summary)


def run_summary(merged: DataFrame, chosen: DataFrame, pareto: DataFrame, config: DiscoveryConfig, requested: DataFrame) -> DataFrame:
    """One row per requested entity with status, selected box and drivers, or the reason it failed."""
    start, end = str(config.start), str(config.end)
    has_cap = "cap" in merged.columns
    facts = merged.groupBy("entity").agg(
        F.count(end).alias("_n_end"), F.count_distinct(LABEL).alias("_classes"),
        (F.max("vulnerability_threshold") if config.auto_threshold else F.lit(None).cast("double")).alias("vulnerability_threshold"),
        vulnerability.single_value(start).alias("_start"), (vulnerability.single_value("cap") if has_cap else F.lit(None).cast("double")).alias("_cap"),
    )
    best = pareto.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_optimization_rows"),
        *[F.max(F.when(F.col("selected_solution"), F.col(c))).alias(f"selected_{c}" if c in ("coverage", "density") else c)
          for c in ("coverage", "density", "selected_density_threshold", "selected_coverage_threshold")],
    )
    out = requested.select("entity").distinct().join(facts, "entity", "left").join(chosen, "entity", "left").join(best, "entity", "left")
    error = (
        F.when(F.col("_n_end").isNull(), F.lit(NO_FUTURES))
        .when(F.col("_n_end") == 0, F.lit(NO_END))
        .when(F.col("_classes") < 2, F.lit(ONE_LABEL))
        .when(F.col("drivers").isNull(), F.lit(NO_DRIVERS))
        .when(F.col("n_optimization_rows").isNull(), F.lit(NO_BOXES))
    )
    ok = error.isNull()
    compare = vulnerability.compare_close
    return out.select(
        "entity", F.when(ok, "success").otherwise("error").alias("status"), F.lit(config.auto_threshold).alias("auto_threshold"),
        F.when(ok, F.col("vulnerability_threshold")).alias("vulnerability_threshold"),
        F.when(ok, compare("vulnerability_threshold", "_start")).alias("threshold_vs_start"),
        F.when(ok, compare("vulnerability_threshold", "_cap")).alias("threshold_vs_cap"),
        "selected_coverage", "selected_density", "selected_density_threshold", "selected_coverage_threshold",
        (F.col("selected_density") < config.min_density).alias("selected_density_below_min"),
        (F.col("selected_coverage") < config.min_coverage).alias("selected_coverage_below_min"),
        F.when(ok, F.array_join("top", "|")).otherwise("").alias("selected_top_features"),
        F.when(ok, F.array_join("drivers", "|")).otherwise("").alias("features_for_optimization"),
        F.coalesce("n_optimization_rows", F.lit(0)).alias("n_optimization_rows"), error.alias("error"),
    )


def batch_reports(result: DiscoveryResult, income: DataFrame, income_groups: Sequence[str], list_cells: bool = False) -> dict[str, DataFrame]:
    return {
        "run_summary": result.run_summary.orderBy("entity"),
        "top_variable_frequency_report": reports.driver_frequency(result.run_summary, income, income_groups, list_cells=list_cells),
        "top_variable_combination_frequency_report": reports.combination_frequency(result.run_summary, income, income_groups, list_cells=list_cells),
    }
