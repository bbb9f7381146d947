"""Folds, regression models and what is read off them."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import calibrate, drivers, elastic, folds, forests, outliers, regression, smooth, tree_models, trees, usefulness
from panelforge.operators.ensemble import generate_ensemble
from panelforge.operators.panel import rolling_features
from panelforge.plans.discovery import features_of
from panelforge.plans.discovery_queries import merged
from panelforge.plans.ensemble_queries import simulated_sql, unit
from panelforge.plans.inputs import CONSTRAINED, END_PERIOD, supplier_panel, table, user_days, with_sql
from panelforge.plans.panel_queries import POS, nested
from panelforge.plans.registry import query, r, rounded
from panelforge.session import checkpoint_folder, staged
from panelforge.sources import io

FEATURES = ["n_lines", "avg_discount", "return_share", "has_bulk", "net_margin"]
TARGET = "log_revenue"
HOLDOUT = 5
# A fixed linear model, so that evaluation can be checked against SQL.
COEFFICIENTS = {"n_lines": 0.035, "avg_discount": -0.4, "return_share": 0.05, "has_bulk": 0.06, "net_margin": 0.001}
INTERCEPT = 5.7
MODEL_SQL = f"{INTERCEPT}::DOUBLE" + "".join(f" + {b}::DOUBLE * {c}" for c, b in COEFFICIENTS.items())


def training(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier panel with the log target."""
    return supplier_panel(spark, sf).withColumn(TARGET, F.log1p("revenue"))


def linear(df: DataFrame) -> DataFrame:
    return df.withColumn(regression.PREDICTION, regression.linear_prediction(COEFFICIENTS, INTERCEPT))


# ------------------------------------------------------------ folds and splits

@query("time_folds", with_sql("panel") + """
, i AS (SELECT entity, period, row_number() OVER (ORDER BY period, entity) - 1 AS i, count(*) OVER () AS n FROM panel)
SELECT entity, period, CAST(CASE WHEN i < n - 5 * (n // 6) THEN -1 ELSE (i - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS fold FROM i""")
def time_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds.time_folds(supplier_panel(spark, sf).select("entity", "period"), 5)


@query("group_folds", with_sql("user_days").replace("WITH ", "WITH RECURSIVE ", 1) + """
, ents AS (SELECT entity, size, row_number() OVER (ORDER BY size DESC, entity) AS rn FROM (SELECT entity, count(*) AS size FROM user_days GROUP BY entity)),
deal(rn, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], -1::BIGINT UNION ALL
  SELECT e.rn, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + e.size ELSE x END), list_position(loads, list_min(loads)) - 1 FROM deal d JOIN ents e ON e.rn = d.rn + 1)
SELECT u.entity, u.period, CAST(fold AS INTEGER) AS fold FROM user_days u JOIN ents e ON u.entity = e.entity JOIN deal ON deal.rn = e.rn""")
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds.group_folds(user_days(spark, sf).select("entity", "period"), 5)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels", ["doc_id", "quality"])
    documents = table(spark, sf, "documents", ["doc_id", "lang", "n_chars"])
    return labels.join(documents, "doc_id").withColumnRenamed("lang", "entity").withColumn("score", (F.col("n_chars") % 100).cast("double") / 100.0)


@query("stratified_split", f"""
WITH d AS (SELECT doc_id, quality, lang AS entity, {unit("lang", "CAST(doc_id AS VARCHAR)", "'quality'", "'42'")} AS u FROM labels JOIN documents USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, quality ORDER BY u) AS rn, count(*) OVER (PARTITION BY entity, quality) AS n FROM d)
SELECT doc_id, quality, entity, rn <= ceil(n / 5.0) AS is_test FROM k""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return drivers.stratified_split(labelled_documents(spark, sf).select("doc_id", "quality", "entity"), "quality", "doc_id")


@query("classification_metrics", f"""
WITH d AS (SELECT lang AS entity, quality = 1 AS y, (n_chars % 100)::DOUBLE / 100.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id)),
c AS (SELECT entity, count(*) AS n_rows, count(*) FILTER (WHERE y AND s >= 0.5) AS tp, count(*) FILTER (WHERE NOT y AND s >= 0.5) AS fp, count(*) FILTER (WHERE NOT y AND s < 0.5) AS tn, count(*) FILTER (WHERE y AND s < 0.5) AS fn FROM d GROUP BY entity),
a AS (SELECT p.entity, avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0 END) AS roc_auc FROM d p JOIN d q ON p.entity = q.entity AND p.y AND NOT q.y GROUP BY p.entity)
SELECT c.entity, n_rows, tp, fp, tn, fn, {r("roc_auc", "roc_auc")}, {r("(tp + tn) / n_rows", "accuracy")},
  {r("CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END", "balanced_accuracy")},
  {r("coalesce(tp / nullif(tp + fp, 0), 0)", "precision")}, {r("coalesce(tp / nullif(tp + fn, 0), 0)", "recall")}, {r("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1")},
  {r("greatest(tp + fn, tn + fp) / n_rows", "baseline_accuracy")} FROM c LEFT JOIN a ON c.entity = a.entity""")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drivers.classification_metrics(labelled_documents(spark, sf), "quality", "score"))


# ------------------------------------------------------------ evaluation of a given model

SCORED_SQL = f"""
scored AS (SELECT *, ln(1 + revenue) AS y, {MODEL_SQL} AS p, period <= (SELECT max(period) FROM panel) - {HOLDOUT} AS is_train FROM panel)"""
ERRORS = f"""{r("avg(abs(y - p))", "mae_log")}, {r("sqrt(avg((y - p) * (y - p)))", "rmse_log")}, {r("avg(abs(exp(y) - exp(p)))", "mae_level")}"""


@query("holdout_eval", with_sql("panel", SCORED_SQL) + f"SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS n_obs, {ERRORS} FROM scored GROUP BY 1")
def holdout_eval(spark: SparkSession, sf: str) -> DataFrame:
    train, test = folds.time_holdout(training(spark, sf), HOLDOUT)
    return rounded(regression.holdout_errors(linear(train), linear(test), TARGET))


@query("median_baseline", with_sql("panel", SCORED_SQL.replace(f"{MODEL_SQL} AS p", f"(SELECT quantile_cont(ln(1 + revenue), 0.5) FROM panel WHERE period <= (SELECT max(period) FROM panel) - {HOLDOUT}) AS p")) + f"""
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS n_obs, {ERRORS} FROM scored GROUP BY 1""")
def median_baseline(spark: SparkSession, sf: str) -> DataFrame:
    train, test = folds.time_holdout(training(spark, sf), HOLDOUT)
    guess = partial(regression.median_baseline, train, target=TARGET)
    return rounded(regression.holdout_errors(guess(train), guess(test), TARGET))


@query("per_entity_errors", with_sql("panel", SCORED_SQL) + f"SELECT entity, count(*) AS n_obs, {ERRORS} FROM scored WHERE NOT is_train GROUP BY 1 HAVING count(*) >= 5")
def per_entity_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, test = folds.time_holdout(training(spark, sf), HOLDOUT)
    return rounded(regression.errors_by_entity(linear(test), TARGET))


@query("worst_entities", with_sql("panel", SCORED_SQL) + f"""
, e AS (SELECT entity, count(*) AS n_obs, {ERRORS} FROM scored WHERE NOT is_train GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM e ORDER BY mae_log DESC, entity LIMIT 10""")
def worst_entities(spark: SparkSession, sf: str) -> DataFrame:
    return regression.extreme_entities(per_entity_errors(spark, sf), "mae_log", 10, worst=True)


EFFECT_SQL = f"""
eff AS (SELECT entity, period, p - p0 AS delta_log, exp(p) - exp(p0) AS delta_level FROM (SELECT *, {MODEL_SQL.replace("* has_bulk", "* 0.0").replace("* net_margin", "* 0.0")} AS p0 FROM scored) WHERE NOT is_train)"""


@query("counterfactual_effect", with_sql("panel", SCORED_SQL, EFFECT_SQL) + f"SELECT entity, period, {r('delta_log', 'delta_log')}, {r('delta_level', 'delta_level')} FROM eff")
def counterfactual_effect(spark: SparkSession, sf: str) -> DataFrame:
    _, test = folds.time_holdout(training(spark, sf), HOLDOUT)
    return rounded(regression.counterfactual(test, ["has_bulk", "net_margin"], linear))


@query("effect_by_entity", with_sql("panel", SCORED_SQL, EFFECT_SQL) + f"""
SELECT entity, {r("avg(delta_log)", "mean_delta_log")}, {r("avg(delta_level)", "mean_delta_level")}, count(*) AS n_obs, {r("quantile_cont(delta_level, 0.5)", "median_delta_level")} FROM eff GROUP BY entity""")
def effect_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    _, test = folds.time_holdout(training(spark, sf), HOLDOUT)
    return rounded(regression.effect_by_entity(regression.counterfactual(test, ["has_bulk", "net_margin"], linear)))


# ------------------------------------------------------------ scoring and post-processing an ensemble

DRIVERS = ["n_lines", "avg_discount", "return_share"]
SCORE = {"n_lines": 0.035, "avg_discount": -0.4, "return_share": 0.05}
SCORE_SQL = "5.7::DOUBLE" + "".join(f" + {b}::DOUBLE * {c}" for c, b in SCORE.items())


def scored_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    paths = generate_ensemble(supplier_panel(spark, sf), CONSTRAINED, DRIVERS)
    log_level = regression.linear_prediction(SCORE, 5.7)
    return paths.select("entity", "future_id", "period", log_level.alias("log_level")).withColumn("level", F.expm1("log_level"))


POST_SQL = f"""
con AS (SELECT entity, future_id, period, greatest(round_even(n_lines, 0), 0) AS n_lines, least(greatest(avg_discount, 0), 1) AS avg_discount, least(greatest(return_share, 0), 1) AS return_share
  FROM sim_n_lines JOIN sim_avg_discount USING (entity, future_id, period) JOIN sim_return_share USING (entity, future_id, period)),
sc AS (SELECT entity, future_id, period, {SCORE_SQL} AS log_level FROM con),
cal AS (SELECT sc.entity, future_id, sc.period, p.revenue + (exp(log_level) - 1 - max(CASE WHEN sc.period = 27 THEN exp(log_level) - 1 END) OVER (PARTITION BY sc.entity, future_id)) AS level
  FROM sc LEFT JOIN panel p ON sc.entity = p.entity AND p.period = 27),
cpos AS (SELECT *, row_number() OVER (PARTITION BY entity, future_id ORDER BY period) AS pos, count(level) OVER (PARTITION BY entity, future_id) AS n FROM cal),
tr AS (SELECT a.entity, a.future_id, a.period, sum(w.w * b.level) AS trend FROM cpos a JOIN cpos b ON a.entity = b.entity AND a.future_id = b.future_id JOIN w ON w.n = a.n AND w.i = a.pos AND w.j = b.pos GROUP BY 1, 2, 3),
q AS (SELECT entity, quantile_cont(trend, 0.25) AS q1, quantile_cont(trend, 0.75) AS q3, count(trend) AS n FROM tr WHERE period = {END_PERIOD} GROUP BY entity),
bad AS (SELECT future_id FROM tr JOIN q USING (entity) WHERE period = {END_PERIOD} AND n >= 5 AND q3 > q1 AND (trend < q1 - 1.5 * (q3 - q1) OR trend > q3 + 1.5 * (q3 - q1)))"""


@query("score_ensemble", with_sql("panel", *[simulated_sql(v) for v in DRIVERS], POST_SQL.split("cal AS")[0].rstrip().rstrip(",")) + f"""
SELECT entity, future_id, period, {r("log_level", "log_level")}, {r("exp(log_level) - 1", "level")} FROM sc""")
def score_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored_ensemble(spark, sf))


@query("score_reloaded_pipeline", with_sql("panel") + f"""
, logs AS (SELECT entity, period, n_lines, ln(1 + revenue) AS y FROM panel),
m AS (SELECT regr_slope(y, n_lines) AS b, regr_intercept(y, n_lines) AS a FROM logs WHERE period <= (SELECT max(period) FROM logs) - {HOLDOUT})
SELECT entity, period, {r("a + b * n_lines", "log_level", 4)}, {r("exp(a + b * n_lines) - 1", "level", 4)} FROM logs, m""")
def score_reloaded_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the training periods, save the pipeline, load it again and score every row with what was loaded."""
    frame = training(spark, sf)
    train, _ = folds.time_holdout(frame, HOLDOUT)
    path = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    io.save_model(regression.fit(train, ["n_lines"], regression.elastic_net(TARGET, 0.0, 0.0, 1.0)), path)
    scored = regression.score(frame.select("entity", "period", "n_lines"), io.load_model(path), "log_level", "level")
    return rounded(scored.select("entity", "period", "log_level", "level"), 4)


def weights() -> str:
    from panelforge.plans.panel_queries import weight_rows

    return weight_rows(100.0, range(9, 11))


@query("postprocess_ensemble", with_sql("panel", *[simulated_sql(v) for v in DRIVERS], weights(), POST_SQL) + f"""
SELECT entity, future_id, period, {r("trend", "level_hp_trend", 4)} FROM cpos LEFT JOIN tr USING (entity, future_id, period) WHERE future_id NOT IN (SELECT future_id FROM bad)""")
def postprocess_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Score, calibrate to the last observed quarter, smooth, drop outlier futures."""
    observed = supplier_panel(spark, sf).select("entity", "period", F.col("revenue").alias("level"))
    calibrated = calibrate.calibrate(scored_ensemble(spark, sf).drop("log_level"), observed, 27, ["level"], method="additive")
    trend = smooth.hp_filter(calibrated, ["level"], ["entity", "future_id"], keep="filtered_only")
    return rounded(outliers.remove_outlier_series(staged(trend), END_PERIOD, "level_hp_trend"), 4)


# ------------------------------------------------------------ fitted models (checked by property tests)

# The training table of :func:`with_trends`: complete rows with the target.
TRAIN_SQL = """
logs AS (SELECT *, ln(1 + revenue) AS y FROM panel),
roll AS (SELECT *, count(y) OVER t3 AS n3, regr_count(y, y) OVER t5 AS n5 FROM logs WINDOW t3 AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), t5 AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
train AS (SELECT * FROM roll WHERE n3 >= 2 AND n5 >= 3)"""


def with_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Training table with trend features, incomplete rows dropped; written once for the many fits."""
    trends = rolling_features(
        training(spark, sf), {"trend_3": {"source": TARGET, "window": 3, "min_periods": 2, "shift": 1}},
        {"volatility_5": {"source": TARGET, "window": 5, "min_periods": 3, "shift": 1}},
    )
    return staged(trends.select("entity", "period", TARGET, *FEATURES, "trend_3", "volatility_5").na.drop())


ALL = [*FEATURES, "trend_3", "volatility_5"]
# The grid of the reference run.
NET = {"n_alphas": 300, "eps": 1e-4}
INNER_FOLDS, OUTER_FOLDS = 7, 5
BOOSTING, TREES = trees.Boosting(rounds=300), trees.Forest(trees=300)
L1_RATIO, L1_RATIOS = 0.01, [0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95]


def search_inputs(spark: SparkSession, sf: str):
    train, test = folds.time_holdout(with_trends(spark, sf), HOLDOUT)
    folded = folds.time_folds(train, INNER_FOLDS)
    scaling = regression.fit_scaling(train, ALL)
    return folded, test, scaling, staged(elastic.fold_products(folded, scaling, TARGET, "fold", "entity"))


def searched_net(frame: DataFrame):
    """Maker of the elastic net whose penalty is searched on the training part it is given."""

    def make(train: DataFrame):
        folded = folds.time_folds(train.drop("fold"), INNER_FOLDS)
        products = elastic.fold_products(folded, regression.fit_scaling(train, ALL), TARGET, "fold", "entity")
        alpha = elastic.net_search(products, ALL, l1_ratios=[L1_RATIO], **NET).models.first()["alpha"]
        return regression.elastic_net(TARGET, alpha, L1_RATIO, train.agg(F.stddev_samp(TARGET)).first()[0])

    return make


@query("enet_fit")
def enet_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Penalty from the search, coefficients from the Spark ML fit, entity columns in both."""
    folded, _, _, products = search_inputs(spark, sf)
    alpha = elastic.net_search(products, ALL, l1_ratios=[L1_RATIO], **NET).models.first()["alpha"]
    spread = folded.agg(F.stddev_samp(TARGET)).first()[0]
    model = regression.fit(folded, ALL, regression.elastic_net(TARGET, alpha, L1_RATIO, spread), group="entity")
    return regression.coefficient_table(model, ALL).withColumn("alpha", F.lit(alpha))


@query("fitted_coefficients", with_sql("panel") + f"""
, logs AS (SELECT entity, period, n_lines, ln(1 + revenue) AS y FROM panel),
t AS (SELECT * FROM logs WHERE period <= (SELECT max(period) FROM logs) - {HOLDOUT}),
means AS (SELECT entity, avg(n_lines) AS mx, avg(y) AS my FROM t GROUP BY entity),
slope AS (SELECT sum((n_lines - mx) * (y - my)) / sum((n_lines - mx) * (n_lines - mx)) AS b FROM t JOIN means USING (entity)),
level AS (SELECT entity, my - b * mx AS u FROM means, slope),
c AS (SELECT 'n_lines' AS feature, b * stddev_pop(n_lines) AS coef, 'num' AS type FROM t, slope GROUP BY b UNION ALL
  SELECT 'entity_' || entity, u - (SELECT arg_min(u, entity) FROM level), 'cat' FROM level WHERE entity <> (SELECT min(entity) FROM level))
SELECT feature, {r("coef", "coef", 4)}, {r("abs(coef)", "abs_coef", 4)}, type FROM c""")
def fitted_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares on one scaled feature and entity columns, whose coefficients follow from means within the entities."""
    train, _ = folds.time_holdout(training(spark, sf), HOLDOUT)
    model = regression.fit(train, ["n_lines"], regression.elastic_net(TARGET, 0.0, 0.0, 1.0), group="entity")
    return rounded(regression.coefficient_table(model, ["n_lines"]), 4)


@query("enet_l1_sweep")
def enet_l1_sweep(spark: SparkSession, sf: str) -> DataFrame:
    _, test, scaling, products = search_inputs(spark, sf)
    return elastic.l1_ratio_sweep(products, scaling, test, TARGET, L1_RATIOS, "entity", **NET)


@query("ablation")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    _, test, scaling, products = search_inputs(spark, sf)
    return elastic.feature_ablation(products, scaling, test, TARGET, L1_RATIO, "entity", **NET)


@query("ablation_median", with_sql("panel", TRAIN_SQL) + f"""
, m AS (SELECT quantile_cont(y, 0.5) AS p FROM train WHERE period <= (SELECT max(period) FROM train) - {HOLDOUT}),
e AS (SELECT avg(abs(exp(y) - exp(p))) AS mae FROM train, m WHERE period > (SELECT max(period) FROM train) - {HOLDOUT})
SELECT CAST(k AS INTEGER) AS n_removed, CAST({len(ALL)} - k AS INTEGER) AS n_features_remaining, CASE WHEN k > 0 THEN ({ALL!r})[{len(ALL)} - k + 1] END AS removed_feature, {r("mae", "test_mae_level")}
FROM e, generate_series(0, {len(ALL)}) t(k)""")
def ablation_median(spark: SparkSession, sf: str) -> DataFrame:
    train, test = folds.time_holdout(with_trends(spark, sf), HOLDOUT)
    return rounded(regression.model_ablation(train, test, ALL, TARGET, None))


CATEGORIES = ["status", "priority", "segment"]
ENCODED = "CASE WHEN coalesce({c}, m_{c}) <> f_{c} AND list_contains(l_{c}, coalesce({c}, m_{c})) THEN '{c}=' || coalesce({c}, m_{c}) END"


@query("encoded_categories", f"""
WITH o AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1997-01-01' AS is_train, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_custkey % 3 > 0 AND (c_mktsegment <> 'HOUSEHOLD' OR o_orderdate >= TIMESTAMP '1997-01-01') THEN c_mktsegment END AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
""" + ",\n".join(f"""{c}_n AS (SELECT {c} AS v, count(*) AS n FROM o WHERE is_train AND {c} IS NOT NULL GROUP BY 1),
{c}_l AS (SELECT arg_min(v, (-n, v)) AS m_{c}, min(v) AS f_{c}, list(v) AS l_{c} FROM {c}_n)""" for c in CATEGORIES) + f"""
SELECT o_orderkey, concat_ws(',', {", ".join(ENCODED.format(c=c) for c in CATEGORIES)}) AS entries FROM o, {", ".join(f"{c}_l" for c in CATEGORIES)}""")
def encoded_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the sparse design over three categorical columns with gaps, fitted on the earlier orders."""
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    orders = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    rows = orders.join(table(spark, sf, "customer", ["c_custkey", "c_mktsegment"]), F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", early.alias("is_train"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"),
        F.when((F.col("o_custkey") % 3 > 0) & ((F.col("c_mktsegment") != "HOUSEHOLD") | ~early), F.col("c_mktsegment")).alias("segment"),
    )
    train = rows.where("is_train")
    model = regression.category_encoder(train, CATEGORIES, "design").fit(train)
    names = F.array(*[F.lit(f"{c}={level}") for c, level in regression.category_names(model)])
    entry = F.transform(vector_to_array("design"), lambda x, i: F.when(x != 0, names[i]))
    return model.transform(rows).select("o_orderkey", F.concat_ws(",", entry).alias("entries"))


@query("rf_fit")
def rf_fit(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = folds.time_holdout(with_trends(spark, sf), HOLDOUT)
    return regression.feature_importances(regression.fit(train, ALL, regression.forest(TARGET)), ALL)


def held_out(spark: SparkSession, sf: str) -> tuple[trees.Binned, Column, Column]:
    """The training table, binned, and the conditions of its training and test rows."""
    frame = with_trends(spark, sf)
    cutoff = frame.agg(F.max("period")).first()[0] - HOLDOUT
    rows = trees.binned(frame.withColumn("key", F.xxhash64("entity", "period")), ALL, ["key", "period", TARGET])
    return rows, F.col("period") <= cutoff, F.col("period") > cutoff


@query("gbt_fit")
def gbt_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows, train, test = held_out(spark, sf)
    fitted = trees.fit_boosted(rows, TARGET, "key", {"boosted": (train, ALL)}, BOOSTING)
    scored = fitted.predict(rows, ["period", TARGET]).withColumn(regression.PREDICTION, F.col(trees.PREDICTED)[0])
    return regression.holdout_errors(scored.where(train), scored.where(test), TARGET)


@query("gbt_importances")
def gbt_importances(spark: SparkSession, sf: str) -> DataFrame:
    rows, train, _ = held_out(spark, sf)
    found = trees.fit_boosted(rows, TARGET, "key", {"boosted": (train, ALL)}, BOOSTING).importances()
    return spark.createDataFrame([(ALL[f], v) for f, v in found.items()], "feature string, importance double")


@query("ablation_boosted")
def ablation_boosted(spark: SparkSession, sf: str) -> DataFrame:
    rows, train, test = held_out(spark, sf)
    return tree_models.tree_ablation(rows, TARGET, "key", train, test, ALL, BOOSTING)


@query("ablation_forest")
def ablation_forest(spark: SparkSession, sf: str) -> DataFrame:
    rows, train, test = held_out(spark, sf)
    return tree_models.tree_ablation(rows, TARGET, "key", train, test, ALL, TREES)


def cv_table(frame: DataFrame, models: dict) -> DataFrame:
    """Mean error of each model over time folds and, but for the one with entity columns, over folds of entities."""
    by_time, by_group = folds.time_folds(frame, OUTER_FOLDS), folds.group_folds(frame, OUTER_FOLDS)
    parts = []
    for name, (make, group) in models.items():
        parts.append(regression.cross_validated_mae(by_time, ALL, TARGET, make, "time", group=group).select(F.lit(name).alias("model"), F.lit("time").alias("kind"), "fold", "n_obs", "mae_log", "mae_level"))
        if group is None:
            parts.append(regression.cross_validated_mae(by_group, ALL, TARGET, make, "group").select(F.lit(name).alias("model"), F.lit("group").alias("kind"), "fold", "n_obs", "mae_log", "mae_level"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def training_part(spark: SparkSession, sf: str) -> DataFrame:
    """The training periods: cross-validation never sees the holdout."""
    return staged(folds.time_holdout(with_trends(spark, sf), HOLDOUT)[0])


def tree_cv(frame: DataFrame) -> DataFrame:
    """Errors of forest and boosting, all folds of each in one fit."""
    by_time = folds.time_folds(frame, OUTER_FOLDS).withColumnRenamed("fold", "time_fold")
    folded = folds.group_folds(by_time, OUTER_FOLDS).withColumnRenamed("fold", "group_fold").withColumn("key", F.xxhash64("entity", "period"))
    rows = trees.binned(folded, ALL, ["key", "time_fold", "group_fold", TARGET])
    kinds = {"time": ("time_fold", OUTER_FOLDS), "group": ("group_fold", OUTER_FOLDS)}
    found = [tree_models.fold_errors(rows, TARGET, "key", kinds, ALL, p).select(F.lit(name).alias("model"), "kind", "fold", "n_obs", "mae_log", "mae_level") for name, p in (("forest", TREES), ("boosted", BOOSTING))]
    return found[0].unionByName(found[1])


@query("cv_errors")
def cv_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Time and group errors of all four models on the training periods."""
    frame = training_part(spark, sf)
    return cv_table(frame, {"elastic_net": (searched_net(frame), "entity"), "median": (None, None)}).unionByName(tree_cv(frame))


CV_MEDIAN_SQL = f"""
known AS (SELECT * FROM train WHERE period <= (SELECT max(period) FROM train) - {HOLDOUT}),
i AS (SELECT *, row_number() OVER (ORDER BY period, entity) - 1 AS i, count(*) OVER () AS n FROM known),
bt AS (SELECT y, CASE WHEN i < n - {OUTER_FOLDS} * (n // {OUTER_FOLDS + 1}) THEN -1 ELSE (i - (n - {OUTER_FOLDS} * (n // {OUTER_FOLDS + 1}))) // (n // {OUTER_FOLDS + 1}) END AS fold FROM i),
ents AS (SELECT entity, size, row_number() OVER (ORDER BY size DESC, entity) AS rn FROM (SELECT entity, count(*) AS size FROM known GROUP BY entity)),
deal(rn, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], -1::BIGINT UNION ALL
  SELECT e.rn, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + e.size ELSE x END), list_position(loads, list_min(loads)) - 1 FROM deal d JOIN ents e ON e.rn = d.rn + 1),
bg AS (SELECT y, deal.fold FROM known t JOIN ents e ON t.entity = e.entity JOIN deal ON deal.rn = e.rn),
f AS (SELECT CAST(i AS INTEGER) AS fold FROM generate_series(0, {OUTER_FOLDS - 1}) t(i)),
mt AS (SELECT 'time' AS kind, f.fold, quantile_cont(y, 0.5) AS p FROM f JOIN bt ON bt.fold < f.fold GROUP BY f.fold),
mg AS (SELECT 'group' AS kind, f.fold, quantile_cont(y, 0.5) AS p FROM f JOIN bg ON bg.fold <> f.fold GROUP BY f.fold),
s AS (SELECT kind, mt.fold, y, p FROM mt JOIN bt ON bt.fold = mt.fold UNION ALL SELECT kind, mg.fold, y, p FROM mg JOIN bg ON bg.fold = mg.fold)"""


@query("cv_errors_median", with_sql("panel", TRAIN_SQL, CV_MEDIAN_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT 'median' AS model, kind, fold, count(*) AS n_obs, {r("avg(abs(y - p))", "mae_log")}, {r("avg(abs(exp(y) - exp(p)))", "mae_level")} FROM s GROUP BY kind, fold""")
def cv_errors_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cv_table(training_part(spark, sf), {"median": (None, None)}))


# Components in SQL: the correlation matrix, as a flat list, is squared again and again until only the product of its first
# eigenvector with itself is left; that part is taken off, and the rest gives the next component.
K, SQUARINGS = len(ALL), 45
PCA_SQL = f"""
logs AS (SELECT *, ln(1 + revenue) AS y FROM panel),
{POS}logs),
{nested("trend_3", 3, 2, 1, "slope", "pos", "y")},
{nested("volatility_5", 5, 3, 1, "std", "pos", "y")},
complete AS (SELECT * FROM logs JOIN trend_3 USING (entity, period) JOIN volatility_5 USING (entity, period) WHERE trend_3 IS NOT NULL AND volatility_5 IS NOT NULL),
c0 AS (SELECT [{", ".join(f"corr({a}, {b})" for a in ALL for b in ALL)}]::DOUBLE[] AS c FROM complete),
powers(component, i, m, c) AS (SELECT 1, 0, list_transform(c, lambda x: x / {K}), c FROM c0 UNION ALL
  SELECT CASE WHEN i < {SQUARINGS} THEN component ELSE component + 1 END, CASE WHEN i < {SQUARINGS} THEN i + 1 ELSE 0 END,
    list_transform(nm, lambda x: x / list_sum([nm[d * {K + 1} + 1] for d in range({K})])), nc
  FROM (SELECT component, i, CASE WHEN i < {SQUARINGS} THEN c ELSE list_transform(range({K * K}), lambda k: c[k + 1] - list_dot_product(m, c) * m[k + 1]) END AS nc,
    CASE WHEN i < {SQUARINGS} THEN list_transform(range({K * K}), lambda k: list_dot_product(m[(k // {K}) * {K} + 1:(k // {K} + 1) * {K}], m[(k % {K}) * {K} + 1:(k % {K} + 1) * {K}])) ELSE nc END AS nm
    FROM powers WHERE component < {K} OR i < {SQUARINGS})),
found AS (SELECT component, m, list_dot_product(m, c) / {K} AS explained FROM powers WHERE i = {SQUARINGS}),
summed AS (SELECT *, sum(explained) OVER (ORDER BY component) AS cumulative FROM found),
kept AS (SELECT * FROM summed WHERE cumulative - explained < 0.95 - 1e-12)"""


@query("pca_loadings", with_sql("panel", PCA_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, squares AS (SELECT component, m, list_transform(range({K}), lambda d: m[d * {K + 1} + 1]) AS s FROM kept),
v AS (SELECT component, ({ALL!r})[d + 1] AS feature, m[(list_position(s, list_max(s)) - 1) * {K} + d + 1] / sqrt(list_max(s)) AS loading FROM squares, range({K}) t(d)),
ranked AS (SELECT *, abs(loading) AS abs_loading, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS rank FROM v)
SELECT component, feature, {r("loading", "loading")}, {r("abs_loading", "abs_loading")}, rank FROM ranked WHERE rank <= 5""")
def pca_loadings(spark: SparkSession, sf: str) -> DataFrame:
    loadings, _ = regression.principal_components(with_trends(spark, sf), ALL)
    return rounded(regression.top_loadings(loadings, 5))


@query("pca_variance", with_sql("panel", PCA_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT component, {r('explained', 'explained')}, {r('cumulative', 'cumulative')} FROM kept")
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.principal_components(with_trends(spark, sf), ALL)[1])


@query("pca_ablation")
def pca_ablation(spark: SparkSession, sf: str) -> DataFrame:
    train, test = folds.time_holdout(with_trends(spark, sf), HOLDOUT)
    spread = train.agg(F.stddev_samp(TARGET)).first()[0]
    return regression.component_ablation(train, test, ALL, TARGET, lambda _: regression.elastic_net(TARGET, 0.001, 0.01, spread), group="entity")


@query("feature_usefulness")
def feature_usefulness(spark: SparkSession, sf: str) -> DataFrame:
    return usefulness.feature_usefulness(with_trends(spark, sf), "n_lines", TARGET, splits=5, boosting=trees.Boosting(rounds=300, depth=4))


@query("forest_importance")
def forest_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importances of every driver statistic, a forest per entity."""
    frame = merged(spark, sf)
    return forests.entity_forests(frame, features_of(frame))[0]


@query("driver_classifier")
def driver_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """What each entity's forest over all driver statistics scores on held-out futures."""
    frame = merged(spark, sf)
    return forests.entity_forests(frame, features_of(frame))[2]
