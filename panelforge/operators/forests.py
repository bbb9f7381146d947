"""A classification forest for every entity: which drivers tell vulnerable futures from others, and how well.

Entities are fitted in tasks that grow one tree after the other; an entity with more than its share of the rows is copied to several
tasks, which share its trees. An entity beyond ``max_rows`` stays distributed: its trees grow level by level in aggregates over its
rows. Both routes give the same trees (see :mod:`panelforge.operators.trees`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import trees
from panelforge.operators.drivers import classification_metrics, stratified_split
from panelforge.session import staged

#: Values (rows x features) up to which an entity is fitted in tasks; trees that grow together in the distributed route.
MAX_VALUES, TREES_AT_ONCE = 10_000_000, 16
#: Tasks that share an entity's trees, at most.
MOST_PARTS = 64
TRAINED, SKIPPED = "trained", "skipped_insufficient_rows_or_classes"  # fixed values
RESULT = "entity string, key long, at long, label int, score double, feature string, importance double, grown long"


def _cut_points(values: np.ndarray, bins: int) -> tuple[np.ndarray, float]:
    """The same cut points and fill as :func:`panelforge.operators.trees.binned`: discrete quantiles of the known values."""
    known = np.sort(values[~np.isnan(values)])
    rank = np.maximum(np.ceil(np.append(np.arange(1, bins) / bins, 0.5) * len(known)).astype(np.int64), 1) - 1
    at = known[rank]
    return np.unique(at[:-1]), float(at[-1])


def _binned(values: np.ndarray, bins: int) -> np.ndarray:
    out = np.empty(values.shape, dtype=np.uint8)
    for f in range(values.shape[1]):
        cuts, fill = _cut_points(values[:, f], bins)
        out[:, f] = np.searchsorted(cuts, np.where(np.isnan(values[:, f]), fill, values[:, f]), side="left")
    return out


def _balanced(n0: int, n1: int) -> trees.TwoClasses:
    return trees.TwoClasses((n0 + n1) / (2.0 * n0), (n0 + n1) / (2.0 * n1))


def _tree_importances(grove: trees.Grove, n_features: int) -> tuple[np.ndarray, int]:
    """Importances summed over the trees that have a cut, and their number."""
    grown = len(np.unique(grove.tree[grove.feature >= 0]))
    return grove.importances(n_features) * grown, grown


def _forest_here(bins, label, keys, wanted, params: trees.Forest, numbers: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Some trees of a forest: their values summed for the ``wanted`` rows' bins, their importances summed, and how many have a cut."""
    return trees.Grower(bins, label, keys, _balanced(int((label == 0).sum()), int((label == 1).sum())), params).sums(numbers, wanted)


def _forest_distributed(rows: DataFrame, wanted: DataFrame | None, width: int, params: trees.Forest) -> tuple[np.ndarray, DataFrame | None]:
    counts = {r["target"]: r["n"] for r in rows.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    loss, gains, grown, sums = _balanced(counts[0], counts[1]), np.zeros(width), 0, []
    for low in range(0, params.trees, TREES_AT_ONCE):
        grove = trees.grow_distributed(rows, width, np.arange(low, min(low + TREES_AT_ONCE, params.trees)), loss, params)
        g, n = _tree_importances(grove, width)
        gains, grown = gains + g, grown + n
        if wanted is not None:
            sums.append(staged(wanted.mapInArrow(trees.sums_of(width, list(range(width)), 0, vars(grove)), "model long, key long, total double"), name="forest-sums"))
    scored = reduce(DataFrame.unionByName, sums).groupBy("key").agg((F.sum("total") / params.trees).alias("score")) if sums else None
    return gains / max(grown, 1), scored


def entity_forests(
    df: DataFrame, features: Sequence[str], label: str = "vulnerability_indicator", id_column: str = "future_id", entity: str = "entity",
    test_share: float = 0.2, params: trees.Forest = trees.Forest(trees=500, min_leaf=2, per_node=-1), bins: int = trees.BINS, max_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Importances (entity, feature, importance), scored test rows (entity, id, label, score) and a summary per entity.

    Per entity a forest learns from four fifths of each class and scores the rest; a second one over all rows gives the importances,
    which are gains, summing to 1. Classes (label 1 against all others) weigh the same. Rows without a label are left out, features without any value in
    an entity are dropped there, and other gaps take the entity's median. Features are binned at the entity's exact quantiles.
    Entities without both classes are skipped: they have a summary, but no importances. The summary has n_rows, n_train, n_test,
    class_0, class_1, n_features, dropped_features (bar-joined), status, mean, median and max of the importances and the test
    metrics as ``test_*``; an entity whose training rows lack a class has no scores. ``max_rows``: rows up to which an entity is
    fitted in tasks (by default as many as hold ``MAX_VALUES`` values).
    """
    features = list(features)
    max_rows = max(1, MAX_VALUES // max(len(features), 1)) if max_rows is None else max_rows
    split = stratified_split(df.where(F.col(label).isNotNull()), label, id_column, test_share, params.seed, entity)
    rows = staged(split.select(
        F.col(entity).cast("string").alias("entity"), F.col(id_column).alias("id"), F.xxhash64(F.col(entity), F.col(id_column)).alias("key"),
        (F.col(label) == 1).cast("int").alias("label"), "is_test", *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)],
    ), name="forest-input")
    known = [F.count(f"_f{i}").alias(f"k{i}") for i in range(len(features))]
    sizes = staged(rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
        F.count_if(F.col("label") == 0).alias("class_0"), F.count_if(F.col("label") == 1).alias("class_1"),
        F.count_if((F.col("label") == 0) & ~F.col("is_test")).alias("train_0"), F.count_if((F.col("label") == 1) & ~F.col("is_test")).alias("train_1"), *known,
    ), name="forest-sizes")
    both = (F.col("class_0") > 0) & (F.col("class_1") > 0)
    dropped = F.filter(F.array(*[F.when(F.col(f"k{i}") == 0, F.lit(c)) for i, c in enumerate(features)]), lambda x: x.isNotNull())
    n_features = len(features)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        # All parts of an entity number its rows alike, also those that share a key.
        part = part.sort_values(["key", "label", "is_test", *[f"_f{i}" for i in range(n_features)]] if part["key"].duplicated().any() else "key", kind="stable")
        values = part[[f"_f{i}" for i in range(n_features)]].to_numpy(np.float64)
        used = np.flatnonzero(~np.isnan(values).all(axis=0))
        label_, keys, test, name = part["label"].to_numpy(), part["key"].to_numpy(), part["is_test"].to_numpy(bool), part["entity"].iloc[0]
        numbers, out = range(int(part["part"].iloc[0]), params.trees, int(part["parts"].iloc[0])), []
        del part
        kinds = {"entity": "object", "key": "Int64", "at": "Int64", "label": "Int32", "score": "float64", "feature": "object", "importance": "float64", "grown": "Int64"}  # keys are 64-bit: never by way of doubles
        table = lambda n, **known: pd.DataFrame({c: pd.Series(known.get(c, [None] * n), dtype=k) if k[0] != "I" else pd.array(known.get(c, [pd.NA] * n), dtype=k) for c, k in kinds.items()})
        if len(used):
            packed = _binned(values[:, used], bins)
            del values
            if len(np.unique(label_[~test])) == 2:
                score, at = _forest_here(packed[~test], label_[~test], keys[~test], packed[test], params, numbers)[0] / params.trees, np.flatnonzero(test)
                out.append(table(len(at), entity=[name] * len(at), key=keys[at], at=at, label=label_[at], score=score))
            _, gains, grown = _forest_here(packed, label_, keys, packed[:0], params, numbers)
            out.append(table(len(used), entity=[name] * len(used), feature=[features[f] for f in used], importance=gains, grown=[grown] * len(used)))
        return pd.concat(out) if out else table(0)

    # An entity with a large share of the rows goes to several tasks. Tasks by explicit number: they take long for their bytes.
    slots = rows.sparkSession.sparkContext.defaultParallelism
    usable = sizes.where(both)
    wanted = usable.where(F.col("n_rows") <= max_rows)
    whole = wanted.agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("k")).first()
    parts = F.least(F.greatest(F.ceil(F.col("n_rows") * F.lit(2.0 * slots / max(whole["n"] or 1, 1))), F.lit(1)), F.lit(min(MOST_PARTS, params.trees))).cast("int")
    dealt = rows.drop("id").join(wanted.select("entity", parts.alias("parts")), "entity").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    n_tasks = max(1, min(2 * (whole["k"] + 2 * slots), max(200, 8 * slots)))
    results = [staged(dealt.repartition(n_tasks, "entity", "part").groupBy("entity", "part").applyInPandas(fit, RESULT), name="forest-results")]
    for hot in usable.where(F.col("n_rows") > max_rows).collect():
        results.append(_hot(rows.where(F.col("entity") == hot["entity"]), hot, features, params, bins))
    found = reduce(DataFrame.unionByName, results)
    importance = found.where(F.col("feature").isNotNull()).groupBy("entity", "feature").agg((F.sum("importance") / F.greatest(F.sum("grown"), F.lit(1))).alias("importance"))
    scored = found.where(F.col("score").isNotNull()).groupBy("entity", "key", "at", "label").agg(F.sum("score").alias("score")).drop("at")
    scored = scored.join(rows.select("entity", "key", "id").distinct(), ["entity", "key"])
    metrics = classification_metrics(scored, "label", "score", entity="entity").drop("n_rows")
    metrics = metrics.withColumnsRenamed({c: f"test_{c}" for c in metrics.columns if c != "entity"})
    spread = importance.groupBy("entity").agg(F.avg("importance").alias("mean_importance"), F.percentile("importance", 0.5).alias("median_importance"), F.max("importance").alias("max_importance"))
    summary = sizes.select(
        "entity", "n_rows", "n_train", "n_test", "class_0", "class_1", (F.lit(n_features) - F.size(dropped)).alias("n_features"),
        F.array_join(dropped, "|").alias("dropped_features"), F.when(both & (F.size(dropped) < n_features), TRAINED).otherwise(SKIPPED).alias("status"),
    ).join(spread, "entity", "left").join(metrics, "entity", "left")
    rename = lambda d: d.withColumnRenamed("entity", entity)
    return rename(importance), rename(scored.select("entity", F.col("id").alias(id_column), F.col("label").alias(label), "score")), rename(summary)


def _hot(rows: DataFrame, size, features: Sequence[str], params: trees.Forest, bins: int) -> DataFrame:
    """One entity's result rows, its data left in place."""
    spark = rows.sparkSession
    used = [i for i in range(len(features)) if size[f"k{i}"]]
    if not used:
        return spark.createDataFrame([], RESULT)
    table = trees.binned(rows, [f"_f{i}" for i in used], ["key", "label", "is_test"], bins).rows.select("key", F.col("label").cast("long").alias("target"), "is_test", "bins")
    train, test = table.where(~F.col("is_test")).select("key", "target", "bins"), table.where("is_test").select("key", "target", "bins")
    name = F.lit(size["entity"])
    gains, _ = _forest_distributed(table.select("key", "target", "bins"), None, len(used), params)
    told = spark.createDataFrame([(features[i], float(g)) for i, g in zip(used, gains)], "feature string, importance double")
    null = lambda kind: F.lit(None).cast(kind)
    out = told.select(name.alias("entity"), null("long").alias("key"), null("long").alias("at"), null("int").alias("label"), null("double").alias("score"), "feature", "importance", F.lit(1).cast("long").alias("grown"))
    if size["train_0"] and size["train_1"]:
        _, scored = _forest_distributed(train, test, len(used), params)
        scored = scored.join(test.select("key", F.col("target").cast("int").alias("label"), F.monotonically_increasing_id().alias("at")), "key")
        out = out.unionByName(scored.select(name.alias("entity"), "key", "at", "label", "score", null("string").alias("feature"), null("double").alias("importance"), null("long").alias("grown")))
    return out
