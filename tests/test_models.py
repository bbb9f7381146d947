import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import drivers, elastic, folds, profile, regression, usefulness


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(12):
        effect = rng.normal()
        for t in range(15):
            a, b, c = rng.normal(size=3)
            b = 0.6 * a + b
            y = 1.0 + 0.8 * a - 0.3 * b + 0.02 * t + effect + 0.2 * rng.normal()
            rows.append((f"E{e:02d}", t, float(y), float(5 + 2 * a), None if rng.random() < 0.05 else float(b), float(c)))
    return spark.createDataFrame(rows, "entity string, period int, y double, a double, b double, c double")


def test_time_folds_are_consecutive_blocks(frame):
    got = folds.time_folds(frame, 5).toPandas().sort_values(["period", "entity"]).fold.to_numpy()
    n, block = len(got), len(got) // 6
    want = np.concatenate([np.full(n - 5 * block, -1), np.repeat(np.arange(5), block)])
    assert (got == want).all()


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for e, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[e], loads[f] = f, loads[f] + n
    return out


@pytest.mark.parametrize("k", [2, 3, 5])
def test_group_folds_equal_the_greedy_loop(spark, k):
    rng = np.random.default_rng(k)
    for sizes in ({f"e{i:03d}": int(n) for i, n in enumerate(rng.integers(1, 9, 60))}, {"big": 40, **{f"s{i}": 1 for i in range(9)}, "m": 7}, {f"u{i:02d}": 4 for i in range(11)}):
        df = spark.createDataFrame([(e,) for e, n in sizes.items() for _ in range(n)], "entity string")
        got = {r["entity"]: r["fold"] for r in folds.group_folds(df, k).distinct().collect()}
        assert got == greedy(sizes, k)


def test_time_holdout(frame):
    train, test = folds.time_holdout(frame, 5)
    assert train.agg(F.max("period")).first()[0] == 9 and test.agg(F.min("period")).first()[0] == 10


@pytest.mark.parametrize("scaler", ["standard", "robust", "minmax"])
def test_scaling_equals_numpy(frame, scaler):
    pdf = frame.select("a", "b").toPandas().astype(float)
    filled = pdf.fillna(pdf.median())
    s = regression.fit_scaling(frame, ["a", "b"], scaler)
    for c in ("a", "b"):
        x = filled[c].to_numpy()
        center, scale = {"standard": (x.mean(), x.std()), "robust": (np.median(x), np.subtract(*np.quantile(x, [0.75, 0.25]))), "minmax": (x.min(), np.ptp(x))}[scaler]
        assert s.center[c] == pytest.approx(center) and s.scale[c] == pytest.approx(scale)


def dense_net(x, y, alpha, l1_ratio, sweeps=200_000):
    """Coordinate descent on centered columns as they are."""
    xm, ym = x.mean(axis=0), y.mean()
    x, y, n = x - xm, y - ym, len(y)
    r, c, b = x.T @ x / n, x.T @ y / n, np.zeros(x.shape[1])
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(b)):
            rest = c[j] - r[j] @ b + r[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - l1, 0) / (r[j, j] + l2)
        if np.max(np.abs(b - before)) < 1e-12:
            break
    return b, ym - xm @ b


def dense_design(folded, scaling, names, entities):
    pdf = folded.select("fold", "entity", "y", *[F.expr(scaling.expression(c)).alias(f"z_{c}") for c in names]).toPandas()
    levels = sorted(pdf.entity.unique())[1:] if entities else []
    return np.column_stack([pdf[[f"z_{c}" for c in names]].to_numpy(), *[(pdf.entity == g).to_numpy(float) for g in levels]]), pdf, levels


@pytest.mark.parametrize("scaler", ["standard", "robust", "minmax"])
@pytest.mark.parametrize("entities", [False, True])
def test_net_search_equals_dense_solves_on_the_scaled_features(frame, scaler, entities):
    names, ratio = ["a", "b", "c"], 0.3
    folded = folds.time_folds(frame, 4)
    scaling = regression.fit_scaling(folded, names, scaler)
    products = elastic.fold_products(folded, scaling, "y", "fold", "entity" if entities else None)
    found = elastic.net_search(products, names, l1_ratios=[ratio], n_alphas=12, eps=1e-3)
    best = found.models.first()
    x, pdf, levels = dense_design(folded, scaling, names, entities)
    y, fold = pdf.y.to_numpy(), pdf.fold.to_numpy()
    top = np.max(np.abs((x - x.mean(axis=0)).T @ (y - y.mean()) / len(y))) / ratio
    alphas = np.geomspace(top, top * 1e-3, 12)
    mse = []
    for alpha in alphas:
        errors = []
        for f in range(4):
            b, b0 = dense_net(x[fold < f], y[fold < f], alpha, ratio)
            errors.append(np.mean((y[fold == f] - x[fold == f] @ b - b0) ** 2))
        mse.append(np.mean(errors))
    k = int(np.argmin(mse))
    assert best["alpha"] == pytest.approx(alphas[k]) and best["cv_mse"] == pytest.approx(mse[k], rel=1e-6)
    b, b0 = dense_net(x, y, alphas[k], ratio)
    np.testing.assert_allclose(best["coefficients"], b[:3], atol=1e-7)
    assert best["intercept"] == pytest.approx(b0, abs=1e-7)
    if entities:
        effects = {r["entity"]: r["effect"] for r in found.effects.collect()}
        np.testing.assert_allclose([effects[g] for g in levels], b[3:], atol=1e-7)
        spread = folded.agg(F.stddev_samp("y")).first()[0]
        model = regression.fit(folded, names, regression.elastic_net("y", alphas[k], ratio, spread), scaler, group="entity")
        np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), b, rtol=2e-3, atol=2e-3)


def test_net_search_does_not_depend_on_blocks_turns_or_partitions(spark, frame, monkeypatch):
    """Pure lasso with a redundant feature, one entity with a third of the rows, entities seen in some folds only."""
    names = ["a", "b", "twice_a"]
    hot = frame.unionByName(frame.where("entity = 'E03'").withColumn("y", F.col("y") + 0.1)).withColumn("twice_a", 2 * F.col("a"))
    folded = folds.time_folds(hot.where("entity != 'E05' OR period < 4").where("entity != 'E06' OR period > 9").withColumn("entity", F.concat("entity", F.col("period") % 2)), 3)
    scaling = regression.fit_scaling(folded, names)
    products = elastic.fold_products(folded, scaling, "y", "fold", "entity")

    def models(df):
        found = elastic.net_search(df, names, l1_ratios=[1.0, 0.5], n_alphas=8)
        return found.models.toPandas().sort_values("l1_ratio"), found.effects.toPandas().sort_values(["l1_ratio", "entity"])

    whole, effects = models(products.coalesce(1))
    monkeypatch.setattr(elastic, "BLOCK", 30)
    monkeypatch.setattr(elastic, "SUMS", 400)
    monkeypatch.setattr(elastic, "CANDIDATES_PER_ROW", 5)
    cut, cut_effects = models(products.repartition(7))
    np.testing.assert_allclose(cut.cv_mse, whole.cv_mse, rtol=1e-7)
    np.testing.assert_allclose(cut_effects.effect, effects.effect, atol=1e-6)
    x, pdf, levels = dense_design(folded, scaling, names, True)
    for i, (_, m) in enumerate(whole.iterrows()):
        mine = effects[effects.l1_ratio == m.l1_ratio]
        assert mine.entity.tolist() == levels
        b, b0 = np.concatenate([m.coefficients, mine.effect]), m.intercept
        other, other0 = dense_net(x, pdf.y.to_numpy(), m.alpha, m.l1_ratio, 20_000)
        cost = lambda b, b0: np.mean((pdf.y - x @ b - b0) ** 2) / 2 + m.alpha * (m.l1_ratio * np.abs(b).sum() + (1 - m.l1_ratio) / 2 * (b @ b))  # noqa: B023, E731
        assert cost(b, b0) == pytest.approx(cost(other, other0), abs=1e-10)


def test_net_search_without_rows_or_folds_has_no_model(frame):
    scaling = regression.fit_scaling(frame, ["a"])
    for part in (frame, frame.where("false")):
        found = elastic.net_search(elastic.fold_products(part, scaling, "y", None, "entity"), ["a"])
        assert found.models.count() == 0 and found.effects.count() == 0


def test_sweep_and_ablation_keep_entity_columns(frame):
    names = ["a", "b", "c"]
    folded = folds.time_folds(frame, 4)
    scaling = regression.fit_scaling(folded, names)
    products = elastic.fold_products(folded, scaling, "y", "fold", "entity")
    ablated = elastic.feature_ablation(products, scaling, frame, "y", 0.5, "entity", n_alphas=15).toPandas().sort_values("n_removed")
    assert ablated.n_features_remaining.tolist() == [3, 2, 1, 0] and ablated.removed_feature.tolist()[1:] == ["c", "b", "a"]
    # Without any feature the entity effects still predict better than the mean.
    y = frame.toPandas().y
    assert ablated.test_mae_level.iloc[-1] < np.mean(np.abs(np.exp(y) - np.exp(y.mean())))
    found = elastic.net_search(products, names, l1_ratios=[0.5], n_alphas=15)
    whole, effects = found.models.first(), {r["entity"]: r["effect"] for r in found.effects.collect()}
    pdf = frame.select("entity", "y", *[F.expr(scaling.expression(c)).alias(c) for c in names]).toPandas()
    fitted = whole["intercept"] + pdf[names].to_numpy() @ np.array(whole["coefficients"]) + pdf.entity.map(effects).fillna(0)
    assert ablated.test_mae_level.iloc[0] == pytest.approx(np.mean(np.abs(np.exp(pdf.y) - np.exp(fitted))))
    sweep = elastic.l1_ratio_sweep(products, scaling, frame, "y", [0.1, 0.9], "entity", n_alphas=15).toPandas().set_index("l1_ratio")
    assert len(sweep) == 2 and (sweep.selected_alpha > 0).all() and (sweep.test_mae_level > 0).all()


def test_categories_of_several_columns(spark):
    rows = [("b", "x'y", None, "one"), ("b", "z\\", None, "one"), ("a", "x'y", None, None), ("a", "z\\", None, "one"), (None, None, None, None), ("c", "z\\", None, "one")]
    train = spark.createDataFrame(rows, "k string, q string, empty string, same string")
    assert regression.most_frequent(train, ["k", "q", "empty"]) == {"k": "a", "q": "z\\"}
    model = regression.category_encoder(train, ["k", "q", "empty", "same"], "v").fit(train)
    assert sorted(regression.category_names(model)) == [("k", "b"), ("k", "c"), ("q", "z\\")]
    new = spark.createDataFrame([(0, "c", "new", "p", "q"), (1, None, None, None, None), (2, "b", "x'y", "p", "one")], "i int, k string, q string, empty string, same string")
    names = regression.category_names(model)
    got = {r["i"]: {names[j] for j, x in enumerate(r["v"].toArray()) if x} for r in model.transform(new).collect()}
    assert got == {0: {("k", "c")}, 1: {("q", "z\\")}, 2: {("k", "b")}}
    none = regression.category_encoder(train, ["empty", "same"], "v").fit(train)
    assert none.transform(new).first()["v"].size == 0 and regression.category_names(none) == []


def test_a_model_with_two_categorical_columns_equals_dense_least_squares(frame):
    pdf = frame.withColumn("kind", F.concat(F.lit("k"), F.col("period") % 3)).toPandas()
    df = frame.withColumn("kind", F.concat(F.lit("k"), F.col("period") % 3))
    model = regression.fit(df, ["a"], regression.elastic_net("y", 0.0, 0.0, 1.0), group=["entity", "kind"])
    columns = [("entity", g) for g in sorted(pdf.entity.unique())[1:]] + [("kind", g) for g in ("k1", "k2")]
    z = (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)
    x = np.column_stack([np.ones(len(pdf)), z, *[(pdf[c] == g).to_numpy(float) for c, g in columns]])
    want = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0]
    got = {r["feature"]: r["coef"] for r in regression.coefficient_table(model, ["a"]).collect()}
    for name, b in zip(["a"] + [f"{c}_{g}" for c, g in columns], want[1:]):
        assert got[name] == pytest.approx(b, abs=1e-5)


def test_other_models_can_be_ablated(frame):
    train, test = folds.time_holdout(frame, 5)
    spread = train.agg(F.stddev_samp("y")).first()[0]
    linear = regression.model_ablation(train, test, ["a", "b"], "y", lambda _: regression.elastic_net("y", 0.01, 0.5, spread), group="entity").toPandas()
    assert linear.removed_feature.tolist() == [None, "b", "a"] and linear.test_mae_level.iloc[0] < linear.test_mae_level.iloc[2]
    trees = regression.model_ablation(train, test, ["a", "b"], "y", lambda _: regression.forest("y", numTrees=5, maxDepth=3)).toPandas()
    median = regression.model_ablation(train, test, ["a", "b"], "y", None).toPandas()
    assert len(trees) == 3 and median.test_mae_level.nunique() == 1
    pcs = regression.component_ablation(train, test, ["a", "b", "c"], "y", lambda _: regression.elastic_net("y", 0.0, 0.0, spread)).toPandas()
    direct = regression.fit(train, ["a", "b", "c"], regression.elastic_net("y", 0.0, 0.0, spread))
    assert pcs.n_components.tolist() == [3, 2, 1]
    assert pcs.test_mae_level.iloc[0] == pytest.approx(direct.transform(test).agg(*regression.error_columns("y")).first()["mae_level"])


def test_classifier_is_scored_on_rows_it_has_not_seen(spark):
    rng = np.random.default_rng(6)
    rows = [(f"E{e}", f"f{i}", float(x := rng.normal()), None, float(rng.normal()), int(x + 0.3 * rng.normal() > 0)) for e in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "entity string, future_id string, x double, empty double, noise double, label int")
    scored, summary = drivers.train_classifier(df, ["x", "empty", "noise"], "label", trees=30, max_depth=6)
    split = drivers.stratified_split(df, "label", "future_id")
    assert {(r["entity"], r["future_id"]) for r in scored.collect()} == {(r["entity"], r["future_id"]) for r in split.where("is_test").collect()}
    for r in summary.collect():
        assert (r["status"], r["n_features"], r["dropped_features"], r["n_train"] + r["n_test"]) == ("trained", 2, "empty", 120) and 24 <= r["n_test"] <= 26
        assert r["test_accuracy"] > 0.75 and r["test_roc_auc"] > 0.8
    one = drivers.train_classifier(df.where("label = 1"), ["x"], "label")[1].collect()
    assert {r["status"] for r in one} == {"not_trained"} and all(r["test_accuracy"] is None for r in one)


def test_group_effects_and_unseen_levels(frame):
    train, new = frame.where("entity <> 'E05'"), frame.where("entity = 'E05'")
    model = regression.fit(train, ["a"], regression.elastic_net("y", 0.0, 0.0, 1.0), group="entity")
    table = regression.coefficient_table(model, ["a"]).toPandas()
    assert (table.type == "cat").sum() == 10 and "entity_E00" not in set(table.feature)
    assert regression.predictions(new, model).where("prediction is null").count() == 0
    assert regression.coefficient_table(model, ["a"], only_groups=True).count() == 10


def test_pca_pipeline_back_projection(frame):
    model = regression.fit(frame, ["a", "b", "c"], regression.elastic_net("y", 0.0, 0.0, 1.0), pca=3)
    direct = regression.fit(frame, ["a", "b", "c"], regression.elastic_net("y", 0.0, 0.0, 1.0))
    back = regression.coefficient_table(model, ["a", "b", "c"], back_project=True).toPandas().set_index("feature").coef
    want = regression.coefficient_table(direct, ["a", "b", "c"]).toPandas().set_index("feature").coef
    np.testing.assert_allclose(back[want.index], want, atol=1e-6)
    assert set(regression.coefficient_table(model, ["a", "b", "c"]).toPandas().feature) == {"pc_1", "pc_2", "pc_3"}
    loadings, variance = regression.principal_components(frame, ["a", "b", "c"], 0.95)
    v = variance.toPandas()
    assert v.cumulative.iloc[-1] >= 0.95 and v.explained.is_monotonic_decreasing
    assert regression.top_loadings(loadings, 2).groupBy("component").count().where("count <> 2").count() == 0


def test_errors_counterfactual_and_effects(spark):
    df = spark.createDataFrame([("A", 0, 1.0, 2.0), ("A", 1, 2.0, 0.0), ("B", 0, 0.0, 4.0)], "entity string, period int, x double, policy double")
    predict = lambda d: d.withColumn("prediction", regression.linear_prediction({"x": 1.0, "policy": 0.5}, 0.1))
    effects = regression.counterfactual(df, ["policy"], predict)
    got = {(r["entity"], r["period"]): r["delta_log"] for r in effects.collect()}
    assert got == pytest.approx({("A", 0): 1.0, ("A", 1): 0.0, ("B", 0): 2.0})
    by = {r["entity"]: r for r in regression.effect_by_entity(effects).collect()}
    assert by["A"]["mean_delta_log"] == pytest.approx(0.5) and by["A"]["n_obs"] == 2
    scored = predict(df).withColumn("y", F.col("x"))
    assert [r["entity"] for r in regression.errors_by_entity(scored, "y", 2).collect()] == ["A"]


def dummy_ridge(train, test, features, alpha):
    """Dense ridge with dummies (first dropped) on scaled features."""
    levels = sorted(train.entity.unique())[1:]
    mean, std = train[features].mean(), train[features].std(ddof=0)

    def design(d):
        return np.column_stack([np.ones(len(d)), (d[features] - mean) / std, *[(d.entity == g).astype(float) for g in levels]])

    x = design(train)
    penalty = np.diag([0.0] + [alpha] * (x.shape[1] - 1))
    b = np.linalg.solve(x.T @ x + penalty, x.T @ train.y.to_numpy())
    return design(test) @ b


def test_condensed_ridge_equals_dense_dummies(frame):
    df = folds.group_folds(frame.select("entity", "period", "a", "y"), 3)
    center = {"period": 7.0, "a": 5.0}
    ridge = usefulness.FixedEffectRidge(usefulness.entity_moments(df, ["period", "a"], "y", center, "entity"), ["period", "a"], "entity", [0.5, 10.0])
    pdf = df.toPandas()
    for k, alpha in enumerate([0.5, 10.0]):
        for f in range(3):
            model = ridge.fit([g for g in range(3) if g != f], k, ["period", "a"])
            test = pdf[pdf.fold == f]
            mine = model.intercept + model.coefficients["period"] * (test.period - 7.0) + model.coefficients["a"] * (test.a - 5.0)
            want = dummy_ridge(pdf[pdf.fold != f], test, ["period", "a"], alpha)
            np.testing.assert_allclose(mine, want, atol=1e-8)
            assert ridge.test_mse(f, model) == pytest.approx(np.mean((test.y - want) ** 2))
    full = ridge.fit([0, 1, 2], 0, ["period", "a"])
    rng, base = np.random.default_rng(0), dummy_ridge(pdf, pdf, ["period", "a"], 0.5)
    sst = ((pdf.y - pdf.y.mean()) ** 2).sum()
    drops = []
    for _ in range(400):
        shuffled = pdf.assign(a=rng.permutation(pdf.a))
        predicted = base + full.coefficients["a"] * (shuffled.a - pdf.a)
        drops.append((((pdf.y - predicted) ** 2).sum() - ((pdf.y - base) ** 2).sum()) / sst)
    assert ridge.permutation_importance(full, "a") == pytest.approx(np.mean(drops), rel=0.02)


def test_usefulness_report(frame):
    got = {r["metric"]: r["value"] for r in usefulness.feature_usefulness(frame, "a", "y", splits=3).collect()}
    noise = {r["metric"]: r["value"] for r in usefulness.feature_usefulness(frame, "c", "y", splits=3).collect()}
    assert got["mae_delta_ridge"] < -0.05 < noise["mae_delta_ridge"] and got["permutation_importance"] > 0.1 > noise["permutation_importance"]


def test_vif_elimination_drops_the_redundant_column(frame):
    wide = frame.select("a", "c", (F.col("a") * 2 + F.col("c") * 0.01).alias("twin"))
    got = {r["variable"]: r["dropped_at"] for r in profile.vif_elimination(wide, ["a", "c", "twin"]).collect()}
    assert got["c"] is None and sorted(str(v) for v in got.values()) == ["1", "None", "None"]
    assert all(r["vif"] <= 5 for r in profile.vif_elimination(wide, ["a", "c", "twin"]).where("dropped_at is null").collect())


def test_forest_cv_and_importances(frame):
    model = regression.fit(frame, ["a", "b", "c"], regression.forest("y", numTrees=5, maxDepth=4))
    top = [r["feature"] for r in regression.feature_importances(model, ["a", "b", "c"], 2).collect()]
    assert top[0] == "a" and len(top) == 2
    errors = regression.cross_validated_mae(folds.group_folds(frame, 2), ["a"], "y", None, "group")
    assert errors.count() == 2 and errors.where("mae_log > 0").count() == 2
    assert regression.score(frame, model, "log_y", "level").where("abs(level - expm1(log_y)) > 1e-9").count() == 0


def test_correlation_matrix_equals_pandas(spark, frame):
    wide = frame.withColumns({"gap": F.when(F.col("period") % 3 > 0, F.col("a") * 1e6 + F.col("c")), "flat": F.lit(2.0)})
    names = ["a", "b", "c", "gap", "flat"]
    got = {(r["row_var"], r["col_var"]): r["correlation"] for r in profile.correlation_matrix(wide, names).collect()}
    want = wide.select(*names).toPandas().astype(float).corr()
    for x in names:
        for y in names:
            if "flat" in (x, y):
                assert got[(x, y)] is None
            else:
                assert got[(x, y)] == pytest.approx(want.loc[x, y], abs=1e-9)


def test_registered_model_queries_fit_at_full_size():
    from panelforge.plans import model_queries

    assert model_queries.BOOSTING.rounds == 300 and model_queries.TREES.trees == 300
