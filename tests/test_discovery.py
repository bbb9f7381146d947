import itertools

import numpy as np
import pytest

from panelforge.operators import boxes, drivers, reports, trajectory, vulnerability
from panelforge.operators.rules import Rulebook

RULES = Rulebook.from_spec({"default_category": "unconstrained", "categories": {"binary": ["b"], "cumulative_binary": ["cb"]}})


def loop_threshold(values):
    """Smallest split point with the least imbalance, by trying every midpoint."""
    v = np.sort(np.array([x for x in values if x is not None]))
    best, gap = v[0], len(v)
    for t in (v[:-1] + v[1:]) / 2:
        g = abs(int((v > t).sum()) - int((v <= t).sum()))
        if g < gap:
            best, gap = t, g
    return best


def test_balancing_threshold_equals_the_loop(spark):
    rng = np.random.default_rng(2)
    groups = {f"G{i}": rng.integers(0, rng.integers(1, 9), rng.integers(1, 15)).astype(float).tolist() for i in range(80)}
    groups |= {"equal": [2.0] * 5, "single": [4.0], "nulls": [1.0, None, 3.0], "hot": [1.0] + [2.0] * 6 + [3.0]}
    df = spark.createDataFrame([(e, v) for e, vs in groups.items() for v in vs], "entity string, v double")
    for sizes in (None, vulnerability.GroupSizes(84, 10**9)):
        got = {r[0]: r[1] for r in vulnerability.balancing_threshold(df, "v", sizes=sizes).collect()}
        assert got == {e: loop_threshold(vs) for e, vs in groups.items()}


def test_labels_and_missing_values(spark):
    df = spark.createDataFrame([("E", "a", 0, 1.0), ("E", "a", 1, 2.0), ("E", "b", 0, 3.0), ("E", "b", 1, 3.0), ("E", "c", 1, 9.0), ("E", "d", 0, 1.0)], "entity string, future_id string, period int, v double")
    fixed = {r["future_id"]: r["vulnerability_indicator"] for r in vulnerability.label_futures(df, "v", 0, 1).collect()}
    assert fixed == {"a": 1, "b": 0, "c": 0, "d": 0}
    auto = {r["future_id"]: (r["vulnerability_threshold"], r["vulnerability_indicator"]) for r in vulnerability.label_futures(df, "v", 0, 1, True).collect()}
    assert auto == {"a": (2.5, 0), "b": (2.5, 1), "c": (2.5, 1), "d": (2.5, 0)}
    caps = spark.createDataFrame([("e", 5.0, 2), ("E", 7.0, 1)], "entity string, cap double, o int")
    assert {r["cap"] for r in vulnerability.attach_caps(vulnerability.label_futures(df, "v", 0, 1), caps, "cap", order=["o"]).collect()} == {7.0}


def test_trajectory_summaries(spark):
    rows = [("E", "a", 0, 0.0, 2.0), ("E", "a", 2, 1.0, None), ("E", "a", 3, 0.0, 8.0), ("E", "b", 0, None, 0.0), ("E", "b", 3, 1.0, 4.0), ("E", "c", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "entity string, future_id string, period int, b double, x double")
    full = {r["future_id"]: r for r in trajectory.summarize(df, ["b", "x"], RULES).collect()}
    assert full["a"]["b__switches"] == 2.0 and full["c"]["b__switches"] == 0.0 and full["a"]["x__slope"] == 2.0
    assert full["a"]["x__delta"] == 6.0 and full["c"]["x__std"] is None and full["a"]["n_periods"] == 3
    change = {r["future_id"]: r for r in trajectory.summarize(df, ["b", "x"], RULES, "pct_change", 0, 3).collect()}
    assert change["a"]["x__pct_change"] == 300.0 and change["a"]["b__change"] == 0.0
    assert change["b"]["x__pct_change"] is None and change["b"]["x__delta"] == 4.0 and change["b"]["b__start"] is None and change["b"]["b__last"] is None
    assert change["c"]["x__last"] is None
    with pytest.raises(ValueError):
        trajectory.summarize(df, ["x"], RULES, "other")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in ("E1", "E2", "const"):
        for i in range(60):
            a, b = (float(rng.integers(0, 12)), float(rng.normal()))
            label = int(a + 4 * b + rng.normal() > 6) if e != "const" else 1
            rows.append((e, f"{e}_{i}", a, -b if e == "E2" else b, label))
    return spark.createDataFrame(rows, "entity string, future_id string, a double, b double, vulnerability_indicator int")


def brute_boxes(pdf, levels):
    """Every box of two drivers by testing every future."""
    ops = {"<": np.less, "<=": np.less_equal, ">": np.greater}
    out = []
    y = pdf.vulnerability_indicator.to_numpy()
    cmps = ["<" if np.corrcoef(pdf[d], y)[0, 1] < 0 else ">" for d in "ab"]
    for qa, qb in itertools.product(levels, levels):
        inside = ops[cmps[0]](pdf.a, np.quantile(pdf.a, qa)) & ops[cmps[1]](pdf.b, np.quantile(pdf.b, qb))
        if inside.any():
            out.append((round(y[inside].sum() / y.sum(), 9), round(y[inside].mean(), 9)))
    return out


def test_grid_equals_brute_force_and_skyline_is_not_dominated(labelled):
    levels = [0.1, 0.25, 0.5, 0.75, 0.9]
    grid = boxes.grid_search(boxes.box_input(labelled, ["a", "b"]), 2, levels)
    got, pdf = grid.toPandas(), labelled.toPandas()
    assert set(got.entity) == {"E1", "E2"}
    front = boxes.pareto(grid, 2).toPandas()
    for e in ("E1", "E2"):
        want = brute_boxes(pdf[pdf.entity == e], levels)
        mine = [(round(c, 9), round(d, 9)) for c, d in got[got.entity == e][["coverage", "density"]].itertuples(index=False)]
        assert sorted(mine) == sorted(want)
        best = {w for w in want if not any(o[0] >= w[0] and o[1] >= w[1] and o != w for o in want)}
        sky = [(round(c, 9), round(d, 9)) for c, d in front[front.entity == e][["coverage", "density"]].itertuples(index=False)]
        assert sorted(sky) == sorted(best)


def test_three_drivers_and_single_driver(labelled):
    three = labelled.withColumn("c", labelled.a - labelled.b)
    one = boxes.grid_search(boxes.box_input(three, ["a"]), 1, [0.25, 0.75]).where("entity = 'E1'").toPandas()
    assert 1 <= len(one) <= 2
    cube = boxes.grid_search(boxes.box_input(three, ["a", "b", "c"]), 3, [0.2, 0.8])
    assert cube.where("entity = 'E1'").count() <= 8
    four = boxes.grid_search(boxes.box_input(three, ["a", "b", "c", "a"]), 4, [0.2, 0.8])
    # The repeated driver adds nothing to a box: levels (i, j, k, l) hold what (min(i, l), j, k) holds.
    counts = {tuple(r[f"l{i}"] for i in range(3)): r["n"] for r in cube.where("entity = 'E1'").collect()}
    assert all(r["n"] == counts[min(r["l0"], r["l3"]), r["l1"], r["l2"]] for r in four.where("entity = 'E1'").collect())


@pytest.mark.parametrize("points, chosen, threshold", [
    ([(0.7, 0.9), (0.9, 0.8)], (0.7, 0.9), 0.85),
    ([(0.5, 0.95), (0.9, 0.72), (0.8, 0.74)], (0.9, 0.72), 0.7),
    ([(0.5, 0.7), (0.4, 0.9)], (0.5, 0.7), None),
    ([(0.7, 0.5), (0.9, 0.4)], (0.7, 0.5), None),
    ([(0.3, 0.5), (0.5, 0.4)], (0.5, 0.4), None),
])
def test_selection_ladder(spark, points, chosen, threshold):
    df = spark.createDataFrame([("E", i, c, d) for i, (c, d) in enumerate(points)], "entity string, l0 int, coverage double, density double")
    row = boxes.select_best(df, 1).where("selected_solution").collect()
    assert len(row) == 1 and (row[0]["coverage"], row[0]["density"]) == chosen and row[0]["selected_density_threshold"] == threshold


def test_driver_importance(spark, labelled):
    noisy = labelled.withColumn("noise__last", labelled.a * 0 + 1).withColumnRenamed("a", "a__last").withColumnRenamed("b", "b__last")
    got = drivers.driver_gini(noisy, ["a__last", "b__last", "noise__last"]).toPandas()
    assert set(got.entity) == {"E1", "E2"}
    assert np.allclose(got.groupby("entity").importance.sum(), 1.0) and (got[got.feature == "noise__last"].importance == 0).all()
    top = drivers.top_drivers(drivers.driver_gini(noisy, ["a__last", "b__last", "noise__last"]), 1).collect()
    assert {r["entity"] for r in top} == {"E1", "E2"} and all(r["driver"] in ("a", "b") for r in top)


def test_gini_equals_direct_computation(spark, labelled):
    got = drivers.driver_gini(labelled, ["a", "b"]).toPandas().set_index(["entity", "feature"]).gain
    for (e, f), gain in got.items():
        pdf = labelled.toPandas()
        pdf = pdf[pdf.entity == e]
        x, y = pdf[f].to_numpy(), pdf.vulnerability_indicator.to_numpy()
        w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        s, best = np.sort(x), 0.0
        for c in {s[max(int(np.ceil(i / 32 * len(s))), 1) - 1] for i in range(1, 32)}:
            purity = 0.0
            for side in (x <= c, x > c):
                if side.any():
                    parts = [w[side & (y == k)].sum() for k in (0, 1)]
                    purity += (parts[0] ** 2 + parts[1] ** 2) / sum(parts)
            best = max(best, purity - 0.5)
        assert gain == pytest.approx(best)


def test_classification_metrics_on_one_class_and_ties(spark):
    df = spark.createDataFrame([("A", 1, 0.9), ("A", 0, 0.9), ("A", 0, 0.1), ("B", 1, 0.2), ("B", 1, 0.8)], "entity string, y int, s double")
    got = {r["entity"]: r for r in drivers.classification_metrics(df, "y", "s").collect()}
    assert got["A"]["roc_auc"] == 0.75 and got["A"]["precision"] == 0.5 and got["B"]["roc_auc"] is None and got["B"]["recall"] == 0.5


def test_reports(spark):
    summary = spark.createDataFrame([
        ("mex", "success", "x|y"), ("USA", "success", "y|x"), ("CAN", "success", "z"), ("BRA", "success", ""), ("ERR", "error", "x"),
    ], "entity string, status string, selected_top_features string")
    income = spark.createDataFrame([("MEX", "Upper middle"), ("USA", "High")], "entity string, income_group string")
    features = reports.driver_frequency(summary, income, ["High", "Upper middle"], list_cells=True).collect()
    assert [(r["feature"], r["count"]) for r in features] == [("x", 2), ("y", 2), ("z", 1)]
    assert features[0]["high_entities"] == "USA" and features[0]["upper_middle_entities"] == "MEX" and features[2]["unclassified_entities"] == "CAN"
    combos = reports.combination_frequency(summary, income, ["High", "Upper middle"], list_cells=True).collect()
    assert [(r["feature_combination"], r["count"]) for r in combos] == [("x|y", 2), ("z", 1)]


def test_whole_batch_reports_errors_and_boxes(spark):
    from panelforge.plans.discovery import DiscoveryConfig, batch_reports, discover

    rng = np.random.default_rng(9)
    rows = []
    for e in ("E1", "E2", "flat", "late"):
        for i in range(40):
            x = float(rng.normal())
            for t in (0, 1):
                if e == "late" and t == 1:
                    continue
                y = 5.0 if e == "flat" else 10 + t * x + 0.1 * float(rng.normal())
                rows.append((e, f"{e}_{i}", t, y, x * t, float(rng.normal()), float(i % 2)))
    df = spark.createDataFrame(rows, "entity string, future_id string, period int, y double, x double, z double, b double")
    wanted = spark.createDataFrame([(e,) for e in ("E1", "E2", "flat", "late", "none")], "entity string")
    config = DiscoveryConfig("y", 0, 1, RULES, top_k=1, extra_features=("z",), quantile_levels=(0.1, 0.3, 0.5, 0.7, 0.9))
    result = discover(df, df, config, wanted)
    got = {r["entity"]: r for r in result.run_summary.collect()}
    assert {e: r["status"] for e, r in got.items()} == {"E1": "success", "E2": "success", "flat": "error", "late": "error", "none": "error"}
    assert got["E1"]["selected_top_features"] == "x" and got["E1"]["features_for_optimization"] == "x|z" and got["E1"]["selected_density"] > 0.8
    assert "one label" in got["flat"]["error"] and "reaches the end period" in got["late"]["error"] and "has no futures" in got["none"]["error"]
    selected = result.pareto.where("selected_solution").toPandas()
    assert len(selected) == 2 and (selected.cmp_0 == ">").all()
    income = spark.createDataFrame([("E1", "High")], "entity string, income_group string")
    reported = batch_reports(result, income, ["High"], list_cells=True)["top_variable_frequency_report"].collect()
    assert [(r["feature"], r["count"], r["high_entities"], r["unclassified_entities"]) for r in reported] == [("x", 2, "E1", "E2")]


@pytest.mark.parametrize("drivers, n_levels", [(1, 17), (2, 5), (3, 8), (4, 6)])
def test_search_from_coarse_to_fine_equals_the_whole_grid(spark, drivers, n_levels):
    """Hot, small, noisy, separable and one-sided entities, ties, repeated rows, and entities with fewer drivers."""
    rng = np.random.default_rng(drivers)
    rows = []
    for e, n, used in (("hot", 900, drivers), ("small", 25, drivers), ("noise", 300, drivers), ("fewer", 200, max(drivers - 1, 1)), ("flat", 40, drivers)):
        for i in range(n):
            x = [float(v) for v in (rng.integers(0, 6, used) if e == "small" else rng.normal(size=used))]
            label = int(rng.integers(0, 2)) if e == "noise" else 1 if e == "flat" else int(sum(x) + rng.normal() * 0.4 > np.sqrt(used) * (3 if e == "small" else 1))
            rows += [(e, f"{e}_{i}", label, [f"d{j}" for j in range(used)], x)] * (2 if i % 10 == 0 else 1)
    df = spark.createDataFrame(rows, "entity string, future_id string, label int, drivers array<string>, values array<double>")
    probs = [round(float(p), 6) for p in np.linspace(0.1, 0.9, n_levels)]
    want = boxes.pareto(boxes.grid_search(df, drivers, probs), drivers)
    got = boxes.skyline_search(df, drivers, probs).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["entity"] for r in got.select("entity").distinct().collect()} >= {"hot", "noise", "fewer"}


def test_search_leaves_most_regions_out(spark):
    """Only regions near the skyline are split further: the last round counts a small part of the grid."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    label = (x.sum(axis=1) > 1).astype(int)
    df = spark.createDataFrame([("E", str(i), int(label[i]), ["a", "b", "c"], [float(v) for v in x[i]]) for i in range(400)], "entity string, future_id string, label int, drivers array<string>, values array<double>")
    written = []

    def stage(table, name):
        written.append(table.cache())
        return written[-1]

    boxes.skyline_search(df, 3, stage=stage).count()
    assert 0 < written[-1].count() < 17 ** 3 / 4


def test_search_of_an_empty_table(spark):
    df = spark.createDataFrame([], "entity string, future_id string, label int, drivers array<string>, values array<double>")
    assert boxes.skyline_search(df, 4).count() == 0
