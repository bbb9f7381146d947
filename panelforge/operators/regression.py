"""Regression on panels with Spark ML.

Preprocessing is one SQL projection with fitted literals, so scaling stays inside the Catalyst plan and is
saved with the pipeline. Elastic-net model search is in :mod:`panelforge.operators.elastic`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.feature import PCA as SparkPCA
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.forest_estimator import ForestEstimator
from panelforge.operators.grouped import GroupSizes, group_quantiles
from panelforge.operators.profile import long_format

SCALERS = ("standard", "robust", "minmax")
PREDICTION = "prediction"
#: Fits of one cross-validation that run side by side.
PARALLEL_FITS = 5


# ---------------------------------------------------------------- preprocessing

def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians, all columns in one aggregate."""
    q = group_quantiles(long_format(df, columns), ["variable"], "value", [0.5])
    return {r["variable"]: r["q"][0] for r in q.collect()}


def median_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found.get(c))) for c in columns})


@dataclass(frozen=True)
class Scaling:
    """Fitted fill, center and scale per numeric feature."""

    features: tuple[str, ...]
    fill: Mapping[str, float]
    center: Mapping[str, float]
    scale: Mapping[str, float]

    def expression(self, c: str) -> str:
        return f"(coalesce(cast(`{c}` as double), {self.fill[c]!r}D) - ({self.center[c]!r}D)) / {self.scale[c]!r}D"

    def stage(self) -> SQLTransformer:
        items = ", ".join(f"{self.expression(c)} AS `_z_{c}`" for c in self.features)
        return SQLTransformer(statement=f"SELECT *, {items} FROM __THIS__")

    def columns(self) -> list[str]:
        return [f"_z_{c}" for c in self.features]


def _filled_stats(row, fill: float, scaler: str) -> tuple[float, float]:
    """Center and spread of a column whose missing values are filled, from moments of the known values."""
    if row is None or not row["n"]:
        return fill, 0.0
    if scaler == "minmax":
        return row["low"], row["high"] - row["low"]
    n, missing = row["n"], row["rows"] - row["n"]
    mean = (n * row["mean"] + missing * fill) / row["rows"]
    squares = n * (row["var"] + (row["mean"] - mean) ** 2) + missing * (fill - mean) ** 2
    return mean, (squares / row["rows"]) ** 0.5


def fit_scaling(df: DataFrame, features: Sequence[str], scaler: str = "standard") -> Scaling:
    """Median fill, then standard (population std), robust (median, IQR) or min-max scaling.

    Features without a value or without spread get scale 1.
    """
    if scaler not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}")
    rows = long_format(df, features)
    moments = {r["variable"]: r for r in rows.groupBy("variable").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).collect()}
    sizes = GroupSizes(len(features), max((r["rows"] for r in moments.values()), default=0))
    middle = group_quantiles(rows, ["variable"], "value", (0.5,), sizes=sizes)
    fill = {c: 0.0 for c in features} | {r["variable"]: r["q"][0] for r in middle.collect()}
    if scaler == "robust":
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias(c) for c in features])
        quartiles = group_quantiles(long_format(filled, features), ["variable"], "value", (0.25, 0.5, 0.75), sizes=sizes)
        stats = {r["variable"]: (r["q"][1], r["q"][2] - r["q"][0]) for r in quartiles.collect()}
    else:
        stats = {c: _filled_stats(moments.get(c), fill[c], scaler) for c in features}
    return Scaling(
        tuple(features), fill, {c: float(stats[c][0]) for c in features}, {c: float(stats[c][1]) or 1.0 for c in features}
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent level (as text) per column, the smallest on a tie, all columns in one aggregate; columns without a value are left out."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    counts = df.select(F.inline(items)).where("level IS NOT NULL").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("level", F.struct((-F.col("n")).alias("most"), F.col("level").alias("name"))).alias("level"))
    return {r["column"]: r["level"] for r in best.collect()}


def category_encoder(df: DataFrame, columns: Sequence[str], output: str = "_group") -> Pipeline:
    """One sparse vector of 0/1 entries over all levels of all ``columns``, the first level of each left out.

    Missing values take the column's most frequent level. Levels that the fitted frame lacks have no entry. A column of one level
    has none either. The first level is blanked when the indexer is fitted, so it shares the slot of the unknown, which is dropped.
    """
    modes = most_frequent(df, columns)
    bounds = df.agg(*[f(F.col(c).cast("string")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]).first()
    first = {c: bounds[f"low_{i}"] for i, c in enumerate(columns) if bounds[f"low_{i}"] != bounds[f"high_{i}"]}
    text = {c: "'" + modes[c].replace("\\", "\\\\").replace("'", "\\'") + "'" for c in first}
    fill = SQLTransformer(statement="SELECT *" + "".join(f", coalesce(cast(`{c}` as string), {text[c]}) AS `_c_{c}`" for c in first) + " FROM __THIS__")
    named = [f"_c_{c}" for c in first]
    stages: list = [fill]
    if first:
        known = df.select(*[F.when(F.col(c).cast("string") != first[c], F.col(c).cast("string")).alias(f"_c_{c}") for c in first])
        index = StringIndexer(inputCols=named, outputCols=[f"_i_{c}" for c in first], handleInvalid="keep").fit(known)
        stages += [index, OneHotEncoder(inputCols=[f"_i_{c}" for c in first], outputCols=[f"_v_{c}" for c in first], dropLast=True)]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[f"_v_{c}" for c in first], outputCol=output)])


def category_names(model: PipelineModel) -> list[tuple[str, str]]:
    """``(column, level)`` of every entry of the vector that a fitted :func:`category_encoder` (or a pipeline with one) makes."""
    from pyspark.ml.feature import StringIndexerModel

    stages = [s for stage in model.stages for s in (stage.stages if isinstance(stage, PipelineModel) else [stage])]
    return [(c.removeprefix("_c_"), level) for s in stages if isinstance(s, StringIndexerModel) for c, labels in zip(s.getInputCols(), s.labelsArray) for level in labels]


def feature_stages(df: DataFrame, features: Sequence[str], scaler: str = "standard", group: str | Sequence[str] | None = None, pca: int | None = None) -> list:
    """Unfitted or literal stages producing the vector ``_features``; ``group``: one or several categorical columns."""
    scaling = fit_scaling(df, features, scaler) if features else None
    stages: list = [scaling.stage()] if scaling else []
    numeric = scaling.columns() if scaling else []
    if pca:
        stages += [VectorAssembler(inputCols=numeric, outputCol="_numeric"), SparkPCA(k=pca, inputCol="_numeric", outputCol="_pcs")]
        numeric = ["_pcs"]
    if group:
        stages.append(category_encoder(df, [group] if isinstance(group, str) else list(group)))
    return [*stages, VectorAssembler(inputCols=numeric + (["_group"] if group else []), outputCol="_features")]


# ---------------------------------------------------------------- estimators

def elastic_net(target: str, alpha: float, l1_ratio: float, target_std: float, **params) -> LinearRegression:
    """Estimator for ``1/(2n) |y - Xb|^2 + alpha (l1 |b|_1 + (1 - l1)/2 |b|_2^2)``.

    Spark fits a label divided by its sample std, which leaves the L1 term as it is but divides the L2
    term; the penalties are converted accordingly.
    """
    reg = alpha * l1_ratio + alpha * (1.0 - l1_ratio) * target_std
    return LinearRegression(
        featuresCol="_features", labelCol=target, predictionCol=PREDICTION, standardization=False,
        regParam=reg, elasticNetParam=(alpha * l1_ratio / reg) if reg else 0.0, **{"maxIter": 500, "tol": 1e-9, **params},
    )


#: The trees of the reference models grow until their leaves are pure; ours end at this depth.
FULL_DEPTH = 30


def forest(target: str, numTrees: int = 300, maxDepth: int = FULL_DEPTH, minInstancesPerNode: int = 1, maxBins: int = 32, seed: int = 42) -> ForestEstimator:  # noqa: N803
    """Spark's own forest holds all trees on the driver, with as many nodes as rows each; this one has its names and defaults, but no tree leaves its task."""
    return ForestEstimator(target, PREDICTION, numTrees, maxDepth, minInstancesPerNode, maxBins, seed)


def boosted(target: str, **params) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_features", labelCol=target, predictionCol=PREDICTION,
        **{"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42, **params},
    )


def fit(df: DataFrame, features: Sequence[str], estimator, scaler: str = "standard", group: str | Sequence[str] | None = None, pca: int | None = None) -> PipelineModel:
    return Pipeline(stages=[*feature_stages(df, features, scaler, group, pca), estimator]).fit(df)


def median_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Predict the training median everywhere."""
    return test.withColumn(PREDICTION, F.lit(medians(train, [target])[target]))


def score(df: DataFrame, model: PipelineModel, output: str, level: str | None = None) -> DataFrame:
    """Add the model's prediction as ``output`` and, if named, its ``expm1`` back-transform."""
    scored = model.transform(df).withColumn(output, F.col(PREDICTION)).select(*[c for c in df.columns if c != output], output)
    return scored.withColumn(level, F.expm1(output)) if level else scored


def predictions(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).select(*df.columns, PREDICTION)


def linear_prediction(coefficients: Mapping[str, float], intercept: float) -> Column:
    """Dot product of a linear model as a plain expression."""
    total = F.lit(float(intercept))
    for c, b in coefficients.items():
        total = total + F.lit(float(b)) * F.col(c)
    return total


# ---------------------------------------------------------------- evaluation

def error_columns(target: str, predicted: str = PREDICTION) -> list[Column]:
    """MAE and RMSE in log space, MAE after ``exp`` of both sides."""
    gap = F.col(target) - F.col(predicted)
    return [
        F.count(gap).alias("n_obs"), F.avg(F.abs(gap)).alias("mae_log"), F.sqrt(F.avg(gap * gap)).alias("rmse_log"),
        F.avg(F.abs(F.exp(target) - F.exp(predicted))).alias("mae_level"),
    ]


def holdout_errors(train: DataFrame, test: DataFrame, target: str, predicted: str = PREDICTION) -> DataFrame:
    """Errors on both splits from one aggregate over the scored rows."""
    both = train.select(target, predicted, F.lit("train").alias("split")).unionByName(test.select(target, predicted, F.lit("test").alias("split")))
    return both.groupBy("split").agg(*error_columns(target, predicted))


def errors_by_entity(scored: DataFrame, target: str, min_obs: int = 5, predicted: str = PREDICTION, entity: str = "entity") -> DataFrame:
    return scored.groupBy(entity).agg(*error_columns(target, predicted)).where(F.col("n_obs") >= min_obs)


def extreme_entities(report: DataFrame, metric: str, k: int = 25, worst: bool = False, entity: str = "entity") -> DataFrame:
    return report.orderBy(F.desc(metric) if worst else F.asc(metric), entity).limit(k)


def counterfactual(df: DataFrame, columns: Sequence[str], predict, keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    """Effect of some columns: prediction as observed minus prediction with them set to zero.

    ``predict`` maps a frame to the frame with ``prediction`` added. Both predictions are made row by
    row on the same frame, so nothing is joined.
    """
    observed = predict(df).withColumnRenamed(PREDICTION, "_with")
    without = predict(observed.withColumns({c: F.lit(0.0) for c in columns}))
    return without.select(
        *keys, (F.col("_with") - F.col(PREDICTION)).alias("delta_log"),
        (F.exp("_with") - F.exp(PREDICTION)).alias("delta_level"),
    )


def effect_by_entity(effects: DataFrame, entity: str = "entity") -> DataFrame:
    middle = group_quantiles(effects, [entity], "delta_level", [0.5]).select(entity, F.col("q")[0].alias("median_delta_level"))
    return effects.groupBy(entity).agg(
        F.avg("delta_log").alias("mean_delta_log"), F.avg("delta_level").alias("mean_delta_level"), F.count(F.lit(1)).alias("n_obs"),
    ).join(middle, entity, "left")


def cross_validated_mae(
    df: DataFrame, features: Sequence[str], target: str, make_estimator, kind: str, scaler: str = "standard",
    group: str | None = None, entity: str = "entity", period: str = "period",
) -> DataFrame:
    """MAE per fold, in log and in level space, of a frame with a ``fold`` column.

    ``time``: fold i is predicted from all earlier folds; ``group``: from all other folds. Preprocessing
    is refitted on every training part.
    """
    folds = [r["fold"] for r in df.where("fold >= 0").select("fold").distinct().orderBy("fold").collect()]

    def errors(f: int) -> DataFrame:
        train = df.where(F.col("fold") < f) if kind == "time" else df.where(F.col("fold") != f)
        test = df.where(F.col("fold") == f)
        if make_estimator is None:
            scored = median_baseline(train, test, target)
        else:
            scored = fit(train, features, make_estimator(train), scaler, group).transform(test)
        return scored.agg(*error_columns(target)).withColumn("fold", F.lit(f))

    # Folds are independent jobs, as in Spark's own cross-validator.
    with ThreadPool(max(1, min(PARALLEL_FITS, len(folds)))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(errors), folds)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- ablation of any model

def model_ablation(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, make_estimator, scaler: str = "standard", group: str | None = None) -> DataFrame:
    """Holdout error while removing features one by one from the end of the list; entity columns stay.

    ``make_estimator`` gives the estimator for a training frame, None stands for the training median. One fit per set.
    """
    rows = []
    for k in range(len(features) + 1):
        kept = list(features[: len(features) - k])
        if make_estimator is None:
            scored = median_baseline(train, test, target)
        elif not kept and not group:
            scored = test.withColumn(PREDICTION, F.lit(train.agg(F.avg(target)).first()[0]))
        else:
            scored = fit(train, kept, make_estimator(train), scaler, group).transform(test)
        error = scored.agg(*error_columns(target)).first()["mae_level"]
        rows.append((features[len(features) - k] if k else None, k, len(kept), error))
    return test.sparkSession.createDataFrame(rows, "removed_feature string, n_removed int, n_features_remaining int, test_mae_level double")


# ---------------------------------------------------------------- components and importances

def principal_components(df: DataFrame, features: Sequence[str], variance: float = 0.95, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Loadings ``feature, component, loading`` and explained variance per component.

    Features are standardized; without ``k`` the fewest components reaching ``variance`` are kept. Signs
    are fixed by making each component's largest loading positive.
    """
    scaling = fit_scaling(df, features)
    vectors = VectorAssembler(inputCols=scaling.columns(), outputCol="_x").transform(scaling.stage().transform(df))
    model = SparkPCA(k=len(features), inputCol="_x", outputCol="_pcs").fit(vectors.select("_x"))
    loadings, explained = model.pc.toArray().copy(), model.explainedVariance.toArray()
    if k is None:
        k = int(np.searchsorted(np.cumsum(explained), variance - 1e-12)) + 1
    k = min(k, len(features))
    for j in range(k):
        if loadings[np.argmax(np.abs(loadings[:, j])), j] < 0:
            loadings[:, j] *= -1
    spark = df.sparkSession
    rows = [(f, j + 1, float(loadings[i, j])) for i, f in enumerate(features) for j in range(k)]
    total = np.cumsum(explained)
    return (
        spark.createDataFrame(rows, "feature string, component int, loading double"),
        spark.createDataFrame([(j + 1, float(explained[j]), float(total[j])) for j in range(k)], "component int, explained double, cumulative double"),
    )


def top_loadings(loadings: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the largest absolute loading on every component."""
    ranked = Window.partitionBy("component").orderBy(F.desc("abs_loading"), "feature")
    return loadings.withColumn("abs_loading", F.abs("loading")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def component_ablation(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, make_estimator, components: int | None = None, scaler: str = "standard", group: str | None = None) -> DataFrame:
    """Holdout error while dropping the last principal component again and again, from all of them down to one.

    Filling, scaling and components are fitted once; each model takes the first k components of the same vectors.
    """
    from pyspark.ml.feature import VectorSlicer

    components = components or len(features)
    prepared = Pipeline(stages=feature_stages(train, features, scaler, group, pca=components)[:-1]).fit(train)
    known, new = prepared.transform(train), prepared.transform(test)
    rows = []
    for k in range(components, 0, -1):
        first = VectorSlicer(inputCol="_pcs", outputCol="_first", indices=list(range(k)))
        inputs = ["_first"] + (["_group"] if group else [])
        model = Pipeline(stages=[first, VectorAssembler(inputCols=inputs, outputCol="_features"), make_estimator(train)]).fit(known)
        rows.append((k, components - k, model.transform(new).agg(*error_columns(target)).first()["mae_level"]))
    return test.sparkSession.createDataFrame(rows, "n_components int, removed_components int, test_mae_level double")


def feature_importances(model: PipelineModel, features: Sequence[str], n: int | None = None) -> DataFrame:
    """Importances of a tree model by feature, largest first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows[:n] if n else rows, "feature string, importance double")


def coefficient_table(model: PipelineModel, features: Sequence[str], back_project: bool = False, only_groups: bool = False) -> DataFrame:
    """Coefficients of a linear pipeline: numeric features (or components) and group levels.

    With ``back_project`` component coefficients are turned into coefficients of the scaled features.
    """
    from pyspark.ml.feature import PCAModel
    from pyspark.sql import SparkSession

    stages = [s for stage in model.stages for s in (stage.stages if isinstance(stage, PipelineModel) else [stage])]
    coefs = model.stages[-1].coefficients.toArray()
    pca = next((s for s in stages if isinstance(s, PCAModel)), None)
    levels = category_names(model)
    numeric, groups = coefs[: len(coefs) - len(levels)], coefs[len(coefs) - len(levels):]
    if pca is not None and back_project:
        numeric = pca.pc.toArray() @ numeric
    names = [f"pc_{i + 1}" for i in range(len(numeric))] if pca is not None and not back_project else list(features)
    kind = "pc" if pca is not None and not back_project else "num"
    rows = [] if only_groups else [(f, float(b), abs(float(b)), kind) for f, b in zip(names, numeric)]
    rows += [(f"{c}_{g}", float(b), abs(float(b)), "cat") for (c, g), b in zip(levels, groups)]
    rows.sort(key=lambda r: (-r[2], r[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, coef double, abs_coef double, type string")
