"""Boxes of driver conditions that isolate the vulnerable futures.

A box bounds each driver at one of a fixed list of quantile levels. Every future is reduced to the grid
cell it falls into, cells are counted per entity, and box counts are sums over cells. The work after
the count is bounded by the occupied cells and the grid (levels ^ drivers per entity, with the quantile levels and the
number of drivers as the caller's choice), whatever the number of futures. Where only the best boxes are wanted, a large
grid is searched from coarse to fine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.aggregates import pearson
from panelforge.operators.grouped import group_quantiles, group_sizes, lookup_join
from panelforge.session import staged

#: Boxes per entity up to which counting the whole grid takes less than the rounds of :func:`skyline_search`.
WHOLE_GRID = 10_000


def levels(lower: float = 0.1, upper: float = 0.9, step: float = 0.05) -> list[float]:
    """Quantile levels searched, e.g. 0.10, 0.15, ..., 0.90."""
    return [round(lower + i * step, 10) for i in range(int(round((upper - lower) / step)) + 1)]


def comparator(driver: Column | str, label: Column | str) -> Column:
    """Side of the box by the sign of the correlation with the label; ``<=`` when it is undefined."""
    x = F.col(driver) if isinstance(driver, str) else driver
    y = F.col(label) if isinstance(label, str) else label
    r = pearson(x, y)
    usable = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 3) & r.isNotNull() & (F.abs(r) >= 1e-9)
    return F.when(usable, F.when(r < 0, "<").otherwise(">")).otherwise("<=")


def comparators(df: DataFrame, drivers: Sequence[str], label: str = "vulnerability_indicator", entity: str = "entity") -> DataFrame:
    """One comparator column per driver and entity."""
    return df.groupBy(entity).agg(*[comparator(d, label).alias(d) for d in drivers])


def satisfies(value: Column, cmp: Column, cutoff: Column) -> Column:
    return (
        F.when(cmp == "<", value < cutoff).when(cmp == "<=", value <= cutoff)
        .when(cmp == ">", value > cutoff).when(cmp == ">=", value >= cutoff)
    )


def box_stats(
    df: DataFrame, drivers: Sequence[str], quantiles: Sequence[float], cmps: Sequence[str],
    label: str = "vulnerability_indicator", entity: str = "entity",
) -> DataFrame:
    """Coverage and density of one given box per entity; cutoffs are the entity's own quantiles."""
    sizes = group_sizes(df, [entity])
    out = df
    for d, p in zip(drivers, quantiles):
        cut = group_quantiles(df, [entity], d, [p], sizes=sizes).select(entity, F.col("q")[0].alias(f"{d}__cutoff"))
        out = lookup_join(out, cut, [entity])
    tests = [satisfies(F.col(d), F.lit(c), F.col(f"{d}__cutoff")) for d, c in zip(drivers, cmps)]
    inside = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
    vulnerable = F.col(label) == 1
    return out.groupBy(entity).agg(
        *[F.first(f"{d}__cutoff").alias(f"{d}__cutoff") for d in drivers],
        F.try_divide(F.count_if(inside & vulnerable), F.count_if(vulnerable)).alias("coverage"),
        F.try_divide(F.count_if(inside & vulnerable), F.count_if(inside)).alias("density"),
    )


def box_input(
    df: DataFrame, drivers: Sequence[str], label: str = "vulnerability_indicator", entity: str = "entity", future: str = "future_id",
) -> DataFrame:
    """One row per complete future: ``entity, future, label, drivers, values`` (same drivers for everyone)."""
    complete = df.na.drop(how="any", subset=[*drivers, label])
    return complete.select(
        entity, future, F.col(label).cast("int").alias("label"), F.array(*[F.lit(d) for d in drivers]).alias("drivers"),
        F.array(*[F.col(d).cast("double") for d in drivers]).alias("values"),
    )


def entity_box_input(
    df: DataFrame, chosen: DataFrame, label: str = "vulnerability_indicator", suffix: str = "__last",
    entity: str = "entity", future: str = "future_id",
) -> DataFrame:
    """As :func:`box_input` with each entity's own drivers.

    ``chosen`` has one row per entity with its ``drivers`` array; values are the ``<driver><suffix>`` columns.
    """
    names = [c.removesuffix(suffix) for c in df.columns if c.endswith(suffix)]
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"{n}{suffix}").cast("double"))])
    rows = lookup_join(df.where(F.col(label).isNotNull()), chosen.select(entity, "drivers"), [entity], "inner").select(
        entity, future, F.col(label).cast("int").alias("label"), "drivers",
        F.transform("drivers", lambda d: values[d]).alias("values"),
    )
    return rows.where(~F.exists("values", lambda x: x.isNull()))


def cutoffs(rows: DataFrame, probs: Sequence[float], entity: str = "entity") -> DataFrame:
    """Per entity the array ``sides`` of ``(driver, cmp, cuts)`` in driver order."""
    sizes = group_sizes(rows, [entity])
    tall = rows.select(entity, "label", F.inline(F.transform(F.arrays_zip("drivers", "values"), lambda x, i: F.struct(
        i.alias("slot"), x["drivers"].alias("driver"), x["values"].alias("value")
    ))))
    keys = [entity, "slot"]
    q = group_quantiles(tall, keys, "value", probs, alias="cuts", sizes=sizes)
    cmps = tall.groupBy(*keys).agg(F.first("driver").alias("driver"), comparator("value", "label").alias("cmp"))
    return cmps.join(q, keys).groupBy(entity).agg(
        F.array_sort(F.collect_list(F.struct("slot", "driver", "cmp", "cuts"))).alias("sides")
    )


def _cells(rows: DataFrame, drivers: int, sides: DataFrame, last: int, entity: str) -> DataFrame:
    """Futures counted by the grid cell they fall into: ``entity, l0.., n, n1``.

    A cell's position per slot is in the order of growing boxes: a row lies in the box of level k iff its position is at most
    k, and in no box beyond ``last``. Entities with fewer drivers leave the last slots out (position -1). Futures stay
    where they are: they meet their entity's cutoffs, become a cell and are counted map-side.
    """
    slots = [f"l{i}" for i in range(drivers)]

    def position(i: int) -> Column:
        value, cmp = f"get(`values`, {i})", f"get(sides, {i}).cmp"
        below = f"size(filter(get(sides, {i}).cuts, c -> c < {value}))"
        upto = f"size(filter(get(sides, {i}).cuts, c -> c <= {value}))"
        return F.expr(
            f"case when {value} is null then -1 when {cmp} = '<' then {upto} when {cmp} = '<=' then {below} else {last + 1} - {below} end"
        )

    placed = lookup_join(rows, sides, [entity], "inner")
    return placed.select(entity, "label", *[position(i).alias(s) for i, s in enumerate(slots)]).groupBy(entity, *slots).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1")
    )


def _rated(boxes: DataFrame, cells: DataFrame, entity: str) -> DataFrame:
    """Boxes of entities with both labels, with the entity's vulnerable futures, coverage and density."""
    totals = cells.groupBy(entity).agg(F.sum("n1").alias("total1"), F.sum("n").alias("total"))
    usable = totals.where((F.col("total1") > 0) & (F.col("total1") < F.col("total"))).select(entity, "total1")
    out = boxes.join(usable, entity)
    return out.withColumns({"coverage": F.col("n1") / F.col("total1"), "density": F.col("n1") / F.col("n")})


def grid_search(
    rows: DataFrame, drivers: int, quantile_levels: Sequence[float] | None = None, sides: DataFrame | None = None,
    entity: str = "entity",
) -> DataFrame:
    """Every non-empty box of every entity with its counts.

    ``rows`` is the layout of :func:`box_input`, with at most ``drivers`` drivers per entity, any number; ``sides`` takes
    the result of :func:`cutoffs` if it is at hand. Entities with fewer drivers leave the last slots out
    (level -1). Result per box: entity, level index per slot ``l0..``, size ``n``, vulnerable ``n1``, entity total
    ``total1``, coverage and density.
    """
    probs = list(quantile_levels or levels())
    slots = [f"l{i}" for i in range(drivers)]
    cells = _cells(rows, drivers, cutoffs(rows, probs, entity) if sides is None else sides, len(probs) - 1, entity)
    boxes = cells
    for s in slots:
        reached = F.expr(f"case when {s} = -1 then array(-1) else filter(sequence(0, {len(probs) - 1}), i -> i >= {s}) end")
        others = [c for c in slots if c != s]
        boxes = boxes.select(entity, *others, "n", "n1", F.explode(reached).alias(s)).groupBy(entity, *slots).agg(
            F.sum("n").alias("n"), F.sum("n1").alias("n1")
        )
    return _rated(boxes, cells, entity)


def _halved(cells: DataFrame, drivers: int, stride: int, last: int, entity: str) -> DataFrame:
    """Cells of regions of twice the stride, as the cells of the regions they split into.

    A region is a range of levels per slot, named by its lowest ones ``r0..``; it holds every future of its largest box, with
    positions below the range moved up to its start, so that what lies at the start is its smallest box. A cell above the
    lower half is in the upper half only; any other is in both.
    """
    for i in range(drivers):
        low, at, middle = f"r{i}", f"l{i}", f"r{i} + {stride}"
        halves = F.expr(
            f"filter(array(struct({low} as r, {at} as l), struct({middle} as r, greatest({at}, {middle}) as l)), "
            f"h -> if(h.r = {low}, {low} = -1 or {at} < {middle}, {low} > -1 and {middle} <= {last}))"
        )
        cells = cells.select(*[c for c in cells.columns if c not in (low, at)], F.inline(halves).alias(low, at))
    keys = [f"{c}{i}" for c in "rl" for i in range(drivers)]
    return cells.groupBy(entity, *keys).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def _promising(cells: DataFrame, drivers: int, entity: str) -> DataFrame:
    """Names of the regions in which a box can still be on the skyline.

    Counts grow with the levels, so no box of a region has more vulnerable futures than its largest box, nor a higher density than
    these futures without more others than in its smallest box. A region goes if a box that was counted, the largest or smallest one of any region, is
    better than both bounds, or equal to one and better than the other. Such a box is kept itself or is beaten by one that is.
    """
    region = [f"r{i}" for i in range(drivers)]
    at_start = reduce(lambda a, b: a & b, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(drivers)])
    regions = cells.groupBy(entity, *region).agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1"),
        F.coalesce(F.sum(F.when(at_start, F.col("n"))), F.lit(0)).alias("n_low"), F.coalesce(F.sum(F.when(at_start, F.col("n1"))), F.lit(0)).alias("n1_low"),
    )
    bound = F.coalesce(F.try_divide("n1", F.col("n1") + F.col("n_low") - F.col("n1_low")), F.lit(0.0))

    def entry(n: str, n1: str, bound: Column) -> Column:
        return F.struct((-F.col(n1)).alias("order"), F.try_divide(n1, n).alias("density"), bound.cast("double").alias("bound"))

    entries = regions.select(entity, *region, F.inline(F.array(entry("n", "n1", bound), entry("n_low", "n1_low", F.lit(None)))))
    by_count = Window.partitionBy(entity).orderBy("order")
    more = F.max("density").over(by_count.rangeBetween(Window.unboundedPreceding, -1))
    as_many = F.max("density").over(by_count.rangeBetween(Window.unboundedPreceding, 0))
    beaten = F.coalesce(F.col("_more") >= F.col("bound"), F.lit(False)) | (F.col("_as_many") > F.col("bound"))
    return entries.withColumns({"_more": more, "_as_many": as_many}).where(F.col("bound").isNotNull() & ~beaten).select(entity, *region)


def skyline_search(
    rows: DataFrame, drivers: int, quantile_levels: Sequence[float] | None = None, sides: DataFrame | None = None,
    entity: str = "entity", stage: Callable[..., DataFrame] = staged,
) -> DataFrame:
    """The boxes that :func:`pareto` keeps of :func:`grid_search`, found from coarse to fine.

    All levels start as one region per entity. In each round regions are halved in every slot and counted, and those whose bounds a
    counted box beats are left out, until regions are single boxes: five rounds for 17 levels. A round works on the remaining regions times the cells
    of one, never more than levels ^ drivers per entity, and usually far less. ``stage`` writes each round's cells, which two steps read.
    """
    probs = list(quantile_levels or levels())
    last = len(probs) - 1
    slots, region = [f"l{i}" for i in range(drivers)], [f"r{i}" for i in range(drivers)]
    counted = stage(_cells(rows, drivers, cutoffs(rows, probs, entity) if sides is None else sides, last, entity), name="box-cells")
    inside = reduce(lambda a, b: a & b, [F.col(s) <= last for s in slots])
    cells = counted.where(inside).withColumns({r: F.least(F.col(s), F.lit(0)) for r, s in zip(region, slots)})
    stride = 1 << last.bit_length()
    while stride > 1:
        stride //= 2
        cells = stage(_halved(cells, drivers, stride, last, entity), name="box-regions")
        cells = lookup_join(cells, _promising(cells, drivers, entity), [entity, *region], "left_semi")
    return pareto(_rated(cells.select(entity, *slots, "n", "n1"), counted, entity), drivers, entity)


def pareto(boxes: DataFrame, drivers: int, entity: str = "entity") -> DataFrame:
    """Boxes not dominated in (coverage, density); equal pairs are represented by their lowest levels.

    Of all boxes with as many vulnerable futures only the densest can stay, so an aggregate leaves at most one row per
    number of vulnerable futures before the window, however many drivers the boxes have.
    """
    slots = [f"l{i}" for i in range(drivers)]
    rest = [c for c in boxes.columns if c not in (entity, "coverage")]
    densest = F.struct(-F.col("density"), *slots)
    unique = boxes.groupBy(entity, "coverage").agg(F.min_by(F.struct(*rest), densest).alias("_b")).select(entity, "coverage", "_b.*")
    larger = Window.partitionBy(entity).orderBy(F.desc("coverage"), F.desc("density")).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("density").over(larger)
    return unique.withColumn("_best", best).where(F.col("_best").isNull() | (F.col("density") > F.col("_best"))).drop("_best")


def select_best(
    results: DataFrame, drivers: int, target_density: float = 0.85, min_density: float = 0.60, min_coverage: float = 0.60,
    density_step: float = 0.05, entity: str = "entity",
) -> DataFrame:
    """Mark one box per entity.

    The density requirement is lowered from the target step by step; the first level with a box of
    sufficient coverage wins, by coverage then density. Without any: sufficient density by coverage,
    else sufficient coverage by density, else the largest coverage. Ties go to the lowest levels.
    """
    rungs = int((target_density - min_density) / density_step + 1e-9) + 1 if target_density >= min_density else 0
    ladder = [target_density - i * density_step for i in range(rungs)]
    step = F.lit(None).cast("int")
    for i in range(len(ladder) - 1, -1, -1):
        step = F.when((F.col("density") >= ladder[i]) & (F.col("coverage") >= min_coverage), F.lit(i)).otherwise(step)
    k = len(ladder)
    tier = (
        F.when(F.col("_step").isNotNull(), F.col("_step")).when(F.col("density") >= min_density, F.lit(k))
        .when(F.col("coverage") >= min_coverage, F.lit(k + 1)).otherwise(F.lit(k + 2))
    )
    by_density = F.col("_tier") == k + 1
    first = F.when(by_density, F.col("density")).otherwise(F.col("coverage"))
    second = F.when(by_density, F.col("coverage")).otherwise(F.col("density"))
    slots = [f"l{i}" for i in range(drivers)]
    ranked = Window.partitionBy(entity).orderBy("_tier", F.desc("_first"), F.desc("_second"), *slots)
    marked = (
        results.withColumn("_step", step).withColumn("_tier", tier)
        .withColumns({"_first": first, "_second": second})
        .withColumn("selected_solution", F.row_number().over(ranked) == 1)
    )
    thresholds = F.element_at(F.array(*[F.lit(t) for t in ladder]), F.col("_step") + 1)
    return marked.withColumns({
        "selected_density_threshold": F.when(F.col("selected_solution") & F.col("_step").isNotNull(), thresholds),
        "selected_coverage_threshold": F.when(F.col("selected_solution"), F.lit(min_coverage)),
    }).drop("_step", "_tier", "_first", "_second")


def with_cutoffs(results: DataFrame, sides: DataFrame, probs: Sequence[float], drivers: int, entity: str = "entity") -> DataFrame:
    """Replace level indices by driver name, quantile level, cutoff value and comparator per slot."""
    last = len(probs) - 1
    out = results.join(sides, entity)
    grid = F.array(*[F.lit(p) for p in probs])
    cols = {}
    for i in range(drivers):
        side = F.get("sides", F.lit(i))
        level = F.when(F.col(f"l{i}") >= 0, F.col(f"l{i}"))
        position = F.when(side["cmp"].isin(">", ">="), F.lit(last) - level).otherwise(level)
        cols[f"driver_{i}"] = side["driver"]
        cols[f"quantile_{i}"] = F.get(grid, position)
        cols[f"cutoff_{i}"] = F.get(side["cuts"], position)
        cols[f"cmp_{i}"] = side["cmp"]
    return out.withColumns(cols).drop("sides", *[f"l{i}" for i in range(drivers)])


def membership(rows: DataFrame, selected: DataFrame, drivers: int, entity: str = "entity", future: str = "future_id") -> DataFrame:
    """Futures with their driver values and whether they lie in the selected box of their entity."""
    best = selected.where("selected_solution").select(entity, *[f"{c}_{i}" for i in range(drivers) for c in ("cutoff", "cmp")])
    values = [F.get("values", F.lit(i)) for i in range(drivers)]
    tests = [F.col(f"cutoff_{i}").isNull() | satisfies(values[i], F.col(f"cmp_{i}"), F.col(f"cutoff_{i}")) for i in range(drivers)]
    return lookup_join(rows, best, [entity], "inner").select(
        entity, future, "label", *[v.alias(f"value_{i}") for i, v in enumerate(values)], reduce(lambda a, b: a & b, tests).alias("in_box")
    )
