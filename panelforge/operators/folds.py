"""Train/test splits and fold assignment."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.grouped import lookup_join, row_index


def time_holdout(df: DataFrame, holdout: int, period: str = "period") -> tuple[DataFrame, DataFrame]:
    """Train on periods up to ``max - holdout``, test on the later ones."""
    cutoff = df.agg(F.max(period)).first()[0] - holdout
    return df.where(F.col(period) <= cutoff), df.where(F.col(period) > cutoff)


def time_folds(df: DataFrame, splits: int, entity: str = "entity", period: str = "period") -> DataFrame:
    """Add ``fold``: rows in (period, entity) order are cut into equal test blocks 0..splits-1.

    Block i is tested on a model trained on everything before it; earlier rows get fold -1. Only the keys
    at which blocks begin are looked up: counts per period tell the periods they lie in, and just those
    periods are sorted by entity. The rows themselves are compared with these keys, not moved.
    """
    per_period = [(r[period], r["n"]) for r in df.groupBy(period).agg(F.count(F.lit(1)).alias("n")).orderBy(period).collect()]
    n = sum(c for _, c in per_period)
    block = n // (splits + 1)
    if block < 1:
        raise ValueError(f"{n} rows are too few for {splits} time folds")
    begins = [n - (splits - j) * block for j in range(splits)]
    wanted, before, sorted_rows = [], 0, 0
    for p, count in per_period:
        inside = [b - before for b in begins if before <= b < before + count]
        if inside:
            wanted += [(p, sorted_rows + offset) for offset in inside]
            sorted_rows += count
        before += count
    keys = df.where(F.col(period).isin(*{p for p, _ in wanted})).select(period, entity)
    positions = [i for _, i in wanted]
    found = {r["_i"]: r for r in row_index(keys, [period, entity], "_i").where(F.col("_i").isin(*positions)).collect()}
    fold = F.lit(-1)
    for i in positions:
        p, e = F.lit(found[i][period]), F.lit(found[i][entity])
        reached = (F.col(period) > p) | ((F.col(period) == p) & (F.col(entity) >= e))
        fold = fold + reached.cast("int")
    return df.withColumn("fold", fold)


def _deal(histogram: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int], list[int]]]:
    """Fold sequence of every block of equally large entities, largest first.

    Each entity goes to the lightest fold (lowest number on a tie). Within a block this soon repeats a
    fixed cycle, so a block is described by a short head and the cycle, however many entities it has.
    """
    loads = [(0, f) for f in range(folds)]
    heapq.heapify(loads)
    blocks, first = [], 0
    for size, count in sorted(histogram, reverse=True):
        head: list[int] = []
        while len(head) < count and max(loads)[0] - loads[0][0] >= size:
            load, f = heapq.heappop(loads)
            head.append(f)
            heapq.heappush(loads, (load + size, f))
        rest, cycle = count - len(head), []
        if rest:
            trial = list(loads)
            heapq.heapify(trial)
            for _ in range(folds):
                load, f = heapq.heappop(trial)
                cycle.append(f)
                heapq.heappush(trial, (load + size, f))
            if len(set(cycle)) < folds:
                raise AssertionError("fold loads did not level out")
            rounds, extra = divmod(rest, folds)
            gain = {f: rounds + (1 if cycle.index(f) < extra else 0) for f in range(folds)}
            loads = [(load + size * gain[f], f) for load, f in loads]
            heapq.heapify(loads)
        blocks.append((first, size, head, cycle))
        first += count
    return blocks


def group_folds(df: DataFrame, folds: int, entity: str = "entity") -> DataFrame:
    """Add ``fold`` so that no entity is in two folds and folds have similar row counts.

    Entities are dealt, largest first and by name within a size, to the currently lightest fold. The
    driver sees only how many entities have each size; positions come from a distributed sort.
    """
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_size"))
    ordered = row_index(sizes, [F.desc("_size"), entity], "_i")
    histogram = [(r["_size"], r["n"]) for r in ordered.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks = df.sparkSession.createDataFrame(
        _deal(histogram, folds) or [(0, 0, [0], [0])], "_first bigint, _size bigint, _head array<int>, _cycle array<int>"
    )
    placed = ordered.join(F.broadcast(blocks), "_size").withColumn("_k", F.col("_i") - F.col("_first"))
    in_head = F.col("_k") < F.size("_head")
    fold = F.when(in_head, F.get("_head", F.col("_k"))).otherwise(
        F.get("_cycle", F.try_mod(F.col("_k") - F.size("_head"), F.lit(folds)))
    )
    assigned = placed.select(entity, fold.alias("fold"))
    return lookup_join(df, assigned, [entity], "inner")
