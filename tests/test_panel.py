import numpy as np
import pandas as pd
import pytest

from panelforge.operators import calibrate, outliers, panel, smooth


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [("A", 1, 1.0), ("A", 2, None), ("A", 4, 4.0), ("A", 5, 8.0), ("B", 1, None), ("B", 2, None), ("C", 1, None), ("C", 2, 0.0), ("C", 3, 5.0)]
    return spark.createDataFrame(rows, "entity string, period int, v double")


def by_key(df, *cols):
    return {(r["entity"], r["period"]): (r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols)) for r in df.collect()}


def test_complete_periods_and_interpolation(gappy):
    full = panel.complete_periods(gappy)
    assert by_key(full, "v")[("A", 3)] is None and full.count() == 10
    got = by_key(panel.interpolate(full, ["v"]), "v")
    assert [got[("A", t)] for t in range(1, 6)] == [1.0, 2.0, 3.0, 4.0, 8.0]
    assert got[("B", 1)] is None and got[("C", 1)] == 0.0


def test_fill_does_not_leak_between_entities(gappy):
    got = by_key(panel.fill_within_group(gappy, ["v"]), "v")
    assert got[("B", 1)] is None and got[("B", 2)] is None and got[("A", 2)] == 1.0 and got[("C", 1)] == 0.0


def test_growth_pads_and_survives_zero(gappy):
    got = by_key(panel.add_growth(gappy, ["v"]), "v_growth_rate")
    assert got[("A", 2)] == 0.0 and got[("A", 4)] == 3.0 and got[("C", 3)] is None


def test_value_at_period_falls_back_to_last_known(gappy):
    got = {r["entity"]: r["v"] for r in panel.value_at_period(gappy, ["v"], 2).collect()}
    assert got == {"A": 8.0, "B": None, "C": 0.0}


def test_rolling_features_equal_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(f"E{e}", t, float(rng.normal())) for e in range(4) for t in range(12)], columns=["entity", "period", "v"])
    pdf.loc[rng.choice(len(pdf), 9, replace=False), "v"] = np.nan
    df = spark.createDataFrame([(e, t, None if np.isnan(v) else v) for e, t, v in pdf.itertuples(index=False)], "entity string, period int, v double")
    got = panel.rolling_features(df, {"s": {"source": "v", "window": 5, "min_periods": 3, "shift": 1}}, {"d": {"source": "v", "window": 4, "min_periods": 2, "shift": 0}})
    got = got.toPandas().sort_values(["entity", "period"]).reset_index(drop=True)

    def slope(y):
        ok = np.isfinite(y)
        return np.polyfit(np.arange(len(y))[ok], y[ok], 1)[0] if ok.sum() >= 2 else np.nan

    want = pdf.groupby("entity")["v"].transform(lambda s: s.rolling(5, min_periods=3).apply(slope, raw=True).shift(1))
    np.testing.assert_allclose(got["s"].to_numpy(float), want.to_numpy(), atol=1e-9)
    std = pdf.groupby("entity")["v"].transform(lambda s: s.rolling(4, min_periods=2).std())
    np.testing.assert_allclose(got["d"].to_numpy(float), std.to_numpy(), atol=1e-9)


def dense_trend(y, penalty):
    d = np.diff(np.eye(len(y)), 2, axis=0)
    return np.linalg.solve(np.eye(len(y)) + penalty * d.T @ d, y)


@pytest.mark.parametrize("length", [1, 2, 3, 4, 9, 40])
def test_banded_trend_equals_dense_solution(length):
    y = np.random.default_rng(length).normal(size=(3, length))
    got = smooth.hp_trend_matrix(y, 100.0)
    want = y if length < 3 else np.stack([dense_trend(v, 100.0) for v in y])
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("penalty, interpolate_missing", [(100.0, True), (1e6, False)])
def test_long_series_are_smoothed_in_chunks_as_a_whole(spark, penalty, interpolate_missing):
    rng = np.random.default_rng(3)
    rows = []
    for entity, n in (("a", 61), ("b", 3), ("c", 8), ("d", 16), (None, 30), ("e", 6), ("f", 17)):
        for t in range(n):
            rows.append((entity, 2 * t, None if rng.random() < 0.15 else float(rng.normal() + t), float(rng.normal()), f"{entity}{t}"))
    df = spark.createDataFrame(rows, "entity string, period int, v double, w double, note string").repartition(5)
    options = {"columns": ["v", "w"], "penalty": penalty, "interpolate_missing": interpolate_missing}
    key = ["entity", "period"]
    for which, keep in (("trend", "both"), ("cycle", "replace")):
        whole = smooth.hp_filter(df, which=which, keep=keep, **options).toPandas().sort_values(key)
        for limit in (8, 25):
            cut = smooth.hp_filter(df, which=which, keep=keep, max_series=limit, **options).toPandas().sort_values(key)
            assert sorted(cut.columns) == sorted(whole.columns) and cut.note.tolist() == whole.note.tolist()
            for c in set(whole.columns) - {*key, "note"}:
                np.testing.assert_allclose(cut[c].to_numpy(float), whole[c].to_numpy(float), atol=1e-7)


def test_hp_filter_short_series_and_identity(spark):
    rows = [("L", t, float(t * t % 7)) for t in range(9)] + [("S", t, 1.0) for t in range(5)] + [("G", t, None if t == 3 else float(t)) for t in range(8)]
    df = spark.createDataFrame(rows, "entity string, period int, v double")
    both = smooth.hp_filter(smooth.hp_filter(df, ["v"]), ["v"], which="cycle").toPandas()
    short = both[both.entity == "S"]
    assert short.v_hp_trend.isna().all()
    line = both[both.entity == "G"]
    np.testing.assert_allclose(line.v_hp_trend.to_numpy(float), line.period.to_numpy(float), atol=1e-8)
    long = both[both.entity == "L"]
    np.testing.assert_allclose((long.v_hp_trend + long.v_hp_cycle).to_numpy(float), long.v.to_numpy(float), atol=1e-9)
    assert "v" not in smooth.hp_filter(df, ["v"], keep="filtered_only").columns
    known_only = smooth.hp_filter(df.where("entity = 'G'"), ["v"], interpolate_missing=False).toPandas().sort_values("period")
    assert known_only.v_hp_trend.isna().sum() == 1


def test_calibration_keeps_differences_ratios_and_missing_base(spark):
    sim = spark.createDataFrame(
        [("A", "f1", 0, 2.0, 9.0), ("A", "f1", 1, 3.0, 9.0), ("A", "f2", 0, 0.0, 9.0), ("A", "f2", 1, 5.0, 9.0), ("B", "g", 1, 4.0, 9.0)],
        "entity string, future_id string, period int, v double, log_v double",
    )
    init = spark.createDataFrame([("A", 0, 10.0), ("A", 1, 99.0)], "entity string, period int, v double")
    add = {(r["future_id"], r["period"]): r["v"] for r in calibrate.calibrate(sim, init, 0, method="additive").collect()}
    assert add == {("f1", 0): 10.0, ("f1", 1): 11.0, ("f2", 0): 10.0, ("f2", 1): 15.0, ("g", 1): None}
    mul = {(r["future_id"], r["period"]): (r["v"], r["log_v"]) for r in calibrate.calibrate(sim, init, 0).collect()}
    assert mul[("f1", 1)][0] == 15.0 and mul[("f1", 1)][1] == pytest.approx(np.log(15.0))
    assert mul[("f2", 1)] == (None, None)
    with pytest.raises(ValueError):
        calibrate.calibrate(sim, init, 0, method="other").collect()


def series(spark, groups):
    rows = [(e, f"{e}_{i}", t, float(v)) for e, values in groups.items() for i, v in enumerate(values) for t in (1, 2)]
    return spark.createDataFrame(rows, "entity string, future_id string, period int, v double")


def test_outlier_series(spark):
    df = series(spark, {"small": [1, 1, 1, 99], "five": [1, 2, 3, 4, 99], "flat": [5, 5, 5, 5, 9], "edge": [0, 2, 3, 4, 7]})
    gone = {r["future_id"] for r in outliers.removed_series(df, 2, "v").collect()}
    assert gone == {"five_4"}
    kept = outliers.remove_outlier_series(df, 2, "v")
    assert kept.count() == df.count() - 2
    assert {r["future_id"] for r in outliers.removed_series(df, 2, "v", zero_iqr_means_none=False).collect()} == {"five_4", "flat_4"}


@pytest.mark.parametrize("limit", [7, 40])
def test_long_series_in_chunks_give_the_same_results(spark, limit):
    rng = np.random.default_rng(8)
    values = [None if rng.random() < 0.4 else float(rng.normal()) for _ in range(140)]
    rows = [("long", t, values[t]) for t in range(100)] + [("short", t, values[100 + t]) for t in range(5)]
    rows += [("gap", t, None if 3 < t < 30 else float(t)) for t in range(35)] + [("none", t, None) for t in range(20)]
    df = spark.createDataFrame(rows, "entity string, period int, v double")
    slope, std = {"s": {"source": "v", "window": 4, "min_periods": 2, "shift": 1}}, {"d": {"source": "v", "window": 3, "min_periods": 2, "shift": 2}}
    for op in (
        lambda **k: panel.add_lags(df, ["v"], **k), lambda **k: panel.add_growth(df, ["v"], **k), lambda **k: panel.interpolate(df, ["v"], **k),
        lambda **k: panel.fill_within_group(df, ["v"], **k), lambda **k: panel.rolling_features(df, slope, std, **k),
    ):
        want, got = (x.toPandas().sort_values(["entity", "period"]).reset_index(drop=True) for x in (op(), op(max_series=limit)))
        assert want.columns.tolist() == got.columns.tolist()
        pd.testing.assert_frame_equal(want, got, check_dtype=False, atol=1e-9)
