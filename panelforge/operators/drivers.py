"""Which drivers separate vulnerable from other futures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalar import stable_unit, standard_name
from panelforge.operators.grouped import GroupSizes, group_quantiles, group_sizes, lookup_join, running_totals
from panelforge.operators.profile import long_format
from panelforge.session import staged

BINS = 32


def driver_gini(
    df: DataFrame, features: Sequence[str], label: str = "vulnerability_indicator", entity: str = "entity", bins: int = BINS,
) -> DataFrame:
    """Importance of every feature for every entity: best weighted Gini gain of a single cut, summing to 1.

    Cut points are exact order statistics of the entity's values, whatever its size; classes weigh ``n / (2 n_class)``
    and missing values take the feature's (lower) median. Entities without both classes give no rows.
    """
    features = list(features)
    rows = df.where(F.col(label).isNotNull())
    sizes = rows.groupBy(entity).agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    largest = sizes.agg(F.max(F.col("_n0") + F.col("_n1")).alias("n"), F.count(F.lit(1)).alias("groups")).first()
    long = long_format(rows.withColumn("_y", F.col(label).cast("int")), features, [entity, "_y"], "feature")
    cuts = group_quantiles(
        long, [entity, "feature"], "value", [i / bins for i in range(1, bins)], discrete=True,
        sizes=GroupSizes(largest["groups"] * len(features), largest["n"] or 0),
    ).select(entity, "feature", "q")
    usable = lookup_join(cuts, sizes.where("_n1 > 0 and _n0 > 0"), [entity], "inner")
    tall = lookup_join(long, usable, [entity, "feature"], "inner").select(
        entity, "feature", "_n0", "_n1", "_y", F.expr(f"size(filter(q, c -> c < coalesce(value, q[{bins // 2 - 1}])))").alias("bin"),
    )
    counted = tall.groupBy(entity, "feature", "bin").agg(
        F.first("_n0").alias("_n0"), F.first("_n1").alias("_n1"),
        F.count_if(F.col("_y") == 0).alias("_c0"), F.count_if(F.col("_y") == 1).alias("_c1"),
    )
    upto = Window.partitionBy(entity, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # Weighted class shares left of the cut; both classes weigh one half in total.
    left0 = F.sum("_c0").over(upto) / (2.0 * F.col("_n0"))
    left1 = F.sum("_c1").over(upto) / (2.0 * F.col("_n1"))
    cut = counted.withColumns({"_l0": left0, "_l1": left1})
    left, right = F.col("_l0") + F.col("_l1"), 1.0 - F.col("_l0") - F.col("_l1")
    purity_left = F.try_divide(F.col("_l0") * F.col("_l0") + F.col("_l1") * F.col("_l1"), left)
    r0, r1 = 0.5 - F.col("_l0"), 0.5 - F.col("_l1")
    purity_right = F.when(right > 1e-12, F.try_divide(r0 * r0 + r1 * r1, right)).otherwise(0.0)
    gain = F.greatest(F.coalesce(purity_left, F.lit(0.0)) + purity_right - 0.5, F.lit(0.0))
    best = cut.groupBy(entity, "feature").agg(F.max(gain).alias("gain"))
    total = F.sum("gain").over(Window.partitionBy(entity))
    return best.withColumn("importance", F.coalesce(F.try_divide(F.col("gain"), total), F.lit(0.0)))


def top_drivers(importance: DataFrame, k: int, entity: str = "entity", feature: str = "feature") -> DataFrame:
    """The k best drivers per entity after merging a driver's statistics (``driver__stat``).

    Importances are compared to nine digits, so that equal gains tie whatever the order of summation; ties go by name.
    """
    per_driver = importance.groupBy(entity, standard_name(feature).alias("driver")).agg(F.max("importance").alias("importance"))
    ranked = Window.partitionBy(entity).orderBy(F.desc(F.round("importance", 9)), "driver")
    return per_driver.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def forest_importance(
    df: DataFrame, features: Sequence[str], label: str = "vulnerability_indicator", trees: int = 500,
    min_leaf: int = 2, max_depth: int = 30, seed: int = 42,
) -> DataFrame:
    """Random-forest importances for one entity or a pooled set, with balanced class weights.

    ``max_depth`` defaults to the deepest tree that Spark grows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from panelforge.operators.regression import median_fill

    rows = df.where(F.col(label).isNotNull())
    counts = {r["_y"]: r["n"] for r in rows.groupBy((F.col(label) == 1).cast("int").alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "feature string, importance double"
    if len(counts) < 2:
        return df.sparkSession.createDataFrame([], schema)
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    filled = median_fill(rows, features).withColumns({"_w": weight, "_y": (F.col(label) == 1).cast("double")})
    ready = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(filled)
    model = RandomForestClassifier(
        labelCol="_y", featuresCol="_x", weightCol="_w", numTrees=trees, minInstancesPerNode=min_leaf,
        maxDepth=max_depth, seed=seed,
    ).fit(ready)
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(values, schema)


def train_classifier(
    df: DataFrame, features: Sequence[str], label: str = "vulnerability_indicator", id_column: str = "future_id", entity: str = "entity",
    test_share: float = 0.2, trees: int = 500, min_leaf: int = 2, max_depth: int = 30, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """A forest trained on four fifths of every (entity, label) and scored on the rest: scored test rows and a summary per entity.

    One fit serves the pooled entities; nothing is fitted per entity. Features without a value in the training rows are dropped, other gaps
    take the training median, classes weigh the same. The summary has n_train, n_test, n_features, dropped_features
    (bar-joined), status and the metrics of the test rows as ``test_*``; without both classes in training nothing is fitted.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from panelforge.operators.regression import medians

    split = staged(stratified_split(df.where(F.col(label).isNotNull()), label, id_column, test_share, seed, entity))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    known = train.agg(*[F.count(c).alias(c) for c in features]).first()
    used = [c for c in features if known[c]]
    classes = {r["_y"]: r["n"] for r in train.groupBy((F.col(label) == 1).cast("int").alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = split.groupBy(entity).agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")).withColumns({
        "n_features": F.lit(len(used)), "dropped_features": F.lit("|".join(c for c in features if not known[c])),
    })
    if len(classes) < 2 or not used:
        scored = test.withColumn("score", F.lit(None).cast("double"))
        status = F.lit("not_trained")
    else:
        fill = medians(train, used)
        n = sum(classes.values())
        weight = F.when(F.col(label) == 1, n / (2.0 * classes[1])).otherwise(n / (2.0 * classes[0]))

        def vectors(rows: DataFrame) -> DataFrame:
            filled = rows.withColumns({f"_x_{i}": F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for i, c in enumerate(used)})
            return VectorAssembler(inputCols=[f"_x_{i}" for i in range(len(used))], outputCol="_x").transform(filled)

        model = RandomForestClassifier(
            labelCol="_y", featuresCol="_x", weightCol="_w", numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=max_depth, seed=seed,
        ).fit(vectors(train).withColumns({"_w": weight, "_y": (F.col(label) == 1).cast("double")}))
        scored = model.transform(vectors(test)).withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")
        status = F.lit("trained")
    scored = staged(scored)
    metrics = classification_metrics(scored, label, "score", entity=entity).drop("n_rows")
    metrics = metrics.withColumnsRenamed({c: f"test_{c}" for c in metrics.columns if c != entity})
    return scored, counts.withColumn("status", status).join(metrics, entity, "left")


def stratified_split(
    df: DataFrame, label: str, id_column: str, test_share: float = 0.2, seed: int = 42, entity: str = "entity",
) -> DataFrame:
    """Add ``is_test``: the ``ceil(share * n)`` smallest hash draws of every (entity, label)."""
    drawn = df.withColumn("_u", stable_unit(entity, id_column, F.lit(label), seed))
    sizes = group_sizes(drawn, [entity, label])
    cut = group_quantiles(drawn, [entity, label], "_u", [test_share], discrete=True, sizes=sizes).select(
        entity, label, F.col("q")[0].alias("_cut")
    )
    return lookup_join(drawn, cut, [entity, label]).withColumn("is_test", F.col("_u") <= F.col("_cut")).drop("_u", "_cut")


def classification_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, entity: str = "entity",
) -> DataFrame:
    """Confusion-based metrics, ROC AUC and majority baseline per entity; a ratio over nothing is 0.

    The AUC counts, for every distinct score, the negatives below it plus half of those equal to it.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    actual, said = F.col(label) == 1, F.col(score) >= threshold
    confusion = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(actual & said).alias("tp"), F.count_if(~actual & said).alias("fp"),
        F.count_if(~actual & ~said).alias("tn"), F.count_if(actual & ~said).alias("fn"),
    )
    per_score = rows.groupBy(entity, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(~actual).alias("_n0"), F.count_if(actual).alias("_n1")
    )
    ranked = running_totals(per_score, [entity], "_s", {"_upto0": "_n0"})
    auc = ranked.groupBy(entity).agg(
        F.try_divide(
            F.sum(F.col("_n1") * (F.col("_upto0") - F.col("_n0") / 2.0)), F.sum("_n1").cast("double") * F.sum("_n0")
        ).alias("roc_auc")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n_rows"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    out = confusion.join(auc, entity, "left").withColumns({
        "accuracy": (tp + tn) / n,
        "balanced_accuracy": F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / 2.0),
        "precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "baseline_accuracy": F.greatest(tp + fn, tn + fp) / n,
    })
    return out
