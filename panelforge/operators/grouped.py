"""Group-wise primitives that do not need a whole group in one task.

An entity may own a large part of all rows. Plain Spark handles that for sums and counts (map-side
combine) and for joins (adaptive splitting), but not for exact quantiles, ranks and running totals, where
``percentile`` or a window pulls a group into one task. The functions here look at the group sizes first (one cheap aggregate over the
key columns); ordinary groups take the built-in route, and larger ones are split by value ranges, in rounds.
All results are exact in both routes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import staged

MAX_GROUP_ROWS = 250_000
#: Rows of a value range that are sorted; larger ranges are split again, into 2 * SPLITS + 1 parts at most.
RANGE_ROWS = 1_000_000
SPLITS, SKETCH_ACCURACY = 63, 2_000


def bin_of(splits: str, value: str) -> Column:
    """Twice the number of split points below the value, plus one if the value is the next of them.

    A binary search in the ``SPLITS`` points of a range: six steps for every row, whatever the data. Values equal
    to a split point have a bin of their own, so that a value that fills a range is told apart.
    """
    steps = ", ".join(str(1 << k) for k in reversed(range(SPLITS.bit_length())))
    below = f"aggregate(array({steps}), 0, (p, s) -> p + if(element_at({splits}, p + s) < {value}, s, 0))"
    return F.expr(f"element_at(transform(array({below}), p -> 2 * p + if(p < {SPLITS} and element_at({splits}, least(p + 1, {SPLITS})) = {value}, 1, 0)), 1)")


@dataclass(frozen=True)
class GroupSizes:
    groups: int
    largest: int


def group_sizes(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Number of groups and rows of the largest one; reads only the key columns."""
    row = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("largest")).first()
    )
    return GroupSizes(int(row["groups"]), int(row["largest"] or 0))


def lookup_join(df: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with one row per key. The engine broadcasts it by its measured size and splits skewed partitions otherwise."""
    return df.join(dimension, list(on), how)


def _interpolate(p: float) -> Column:
    """Linear quantile from ``rank -> value`` map ``_at`` and group count ``n``."""
    pos = (F.col("n") - 1) * F.lit(p)
    low, high = F.floor(pos), F.ceil(pos)
    return F.when(low == high, F.col("_at")[low]).otherwise(
        (high - pos) * F.col("_at")[low] + (pos - low) * F.col("_at")[high]
    )


def _ranks(probs: Sequence[float], discrete: bool) -> Column:
    """Zero-based ranks needed for the probabilities, given the group count ``n``."""
    ranks = []
    for p in probs:
        if discrete:
            ranks.append(F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) - 1)
        else:
            pos = (F.col("n") - 1) * F.lit(p)
            ranks += [F.floor(pos), F.ceil(pos)]
    return F.array_distinct(F.array(*[r.cast("bigint") for r in ranks]))


def _select_ranks(rows: DataFrame, keys: list[str], largest: int, ranks: Column) -> DataFrame:
    """Values at the wanted ranks of every group: ``keys, n, _at map<bigint,double>``.

    Selection in rounds: a range of values (first the whole group) is split at points from a bounded sketch of its own rows, the
    rows of each part are counted, and only parts that hold a wanted rank go on. Parts of one value are answered at once; the
    others are split again until they are small enough to sort. Each round does the same small work for each remaining row, and
    few rows remain, however large a group is. The split points need not be accurate for the result to be exact.
    """
    ranges = rows.groupBy(*keys).agg(F.count("_v").alias("n")).withColumns({"_r": F.lit("").cast("string"), "_start": F.lit(0).cast("bigint"), "_ranks": ranks})
    rows, answered = rows.withColumn("_r", F.lit("")), []
    probs = [i / (SPLITS + 1) for i in range(1, SPLITS + 1)]
    while largest > RANGE_ROWS:
        sketch = rows.groupBy(*keys, "_r").agg(F.percentile_approx("_v", probs, SKETCH_ACCURACY).alias("_splits"))
        binned = lookup_join(rows, sketch, [*keys, "_r"], "inner").select(*keys, "_r", "_v", bin_of("_splits", "_v").alias("_b"))
        in_order = Window.partitionBy(*keys, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counted = binned.groupBy(*keys, "_r", "_b").agg(F.count("_v").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        counted = counted.withColumn("_before", F.coalesce(F.sum("_c").over(in_order), F.lit(0)))
        held = lookup_join(counted, ranges, [*keys, "_r"], "inner").withColumn("_start", F.col("_start") + F.col("_before"))
        held = staged(
            held.withColumn("_ranks", F.expr("filter(_ranks, r -> r >= _start and r < _start + _c)")).where(F.size("_ranks") > 0)
            .select(*keys, "n", "_r", "_b", "_start", "_ranks", "_c", "_low", "_high"), name="rank-ranges",
        )
        answered.append(held.where("_low = _high").select(*keys, "n", F.explode("_ranks").alias("_r"), F.col("_low").alias("_v")))
        deeper = held.where("_low < _high")
        name = F.concat_ws(".", "_r", F.col("_b").cast("string")).alias("_r")
        rows = staged(lookup_join(binned, deeper.select(*keys, "_r", "_b"), [*keys, "_r", "_b"], "inner").select(*keys, "_v", name), name="rank-rows")
        ranges = deeper.select(*keys, "n", name, "_start", "_ranks")
        largest = deeper.agg(F.max("_c")).first()[0] or 0
    per_value = rows.groupBy(*keys, "_r", "_v").agg(F.count("_v").alias("_c"))
    within = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ended = lookup_join(per_value.withColumn("_upto", F.sum("_c").over(within)), ranges, [*keys, "_r"], "inner").withColumn("_end", F.col("_start") + F.col("_upto"))
    found = ended.select(*keys, "n", F.explode(F.expr("filter(_ranks, r -> r >= _end - _c and r < _end)")).alias("_r"), "_v")
    for part in answered:
        found = found.unionByName(part)
    return found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    alias: str = "q",
    discrete: bool = False,
    sizes: GroupSizes | None = None,
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact quantiles per group: ``keys, n, <alias> array<double>`` in the order of ``probs``.

    Linear interpolation by default; ``discrete`` returns the smallest value whose cumulative share
    reaches the probability. NULL values are skipped; ``keys`` may be empty. Sizes are counted with the
    NULLs, so the count reads key columns only.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = sizes or group_sizes(df, keys)
    if sizes.largest <= max_group:
        if discrete:
            wanted = ", ".join(f"{float(p)!r}D" for p in probs)
            q = F.expr(f"percentile_disc(array({wanted})) within group (order by _v)")
            return rows.groupBy(*keys).agg(F.count("_v").alias("n"), q.alias(alias))
        return rows.groupBy(*keys).agg(
            F.count("_v").alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias(alias)
        )
    grouping = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    found = _select_ranks(rows, grouping, sizes.largest, _ranks(probs, discrete))
    if discrete:
        items = [F.col("_at")[F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) - 1] for p in probs]
    else:
        items = [_interpolate(p) for p in probs]
    return found.select(*keys, "n", F.array(*items).alias(alias))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: dict[str, str],
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add inclusive running sums ``{output: measure}`` in ascending ``order`` within each group.

    ``order`` must be numeric and unique within a group (aggregate ties first).
    """
    keys = list(keys)
    sizes = group_sizes(df, keys)
    if sizes.largest <= max_group:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(m).over(w) for out, m in measures.items()})
    # Rows in order over all tasks: a hot group lies in as many parts as its share of the rows asks for.
    grouping = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    binned = staged(rows.repartitionByRange(*grouping, order).withColumn("_b", F.spark_partition_id()), name="ordered-rows")
    within = Window.partitionBy(*grouping, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*grouping).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*grouping, "_b").agg(*[F.sum(m).alias(f"_s_{o}") for o, m in measures.items()])
    offsets = totals.select(*grouping, "_b", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in measures])
    joined = lookup_join(binned, offsets, [*grouping, "_b"])
    out = joined.withColumns({o: F.col(f"_s_{o}") + F.sum(m).over(within) for o, m in measures.items()})
    return out.drop("_b", *[f"_s_{o}" for o in measures], *([] if keys else ["_all"]))


def row_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_index") -> DataFrame:
    """Add the exact zero-based position of every row in a global order.

    A range-partitioned sort, then per-partition counts: no task sees more than one sort partition.
    The sorted rows are written once to the checkpoint folder so that the positions and the counts
    come from the same partitioning even when an executor is lost.
    """
    in_partition = (1 << 33) - 1
    placed = staged(
        df.orderBy(*order).select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(in_partition)).alias("_in_part"),
        )
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).collect()
    total, starts = 0, []
    for row in sorted(counts, key=lambda r: r["_part"]):
        starts.append((row["_part"], total))
        total += row["_c"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start bigint")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_in_part"))
        .drop("_part", "_in_part", "_start")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``. An aggregate, so repeated keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
