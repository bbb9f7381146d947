import numpy as np
import pytest

from panelforge.operators import probability

NAN = float("nan")


@pytest.fixture(scope="module")
def ensemble(spark):
    rows = [(e, f"{e}_{i}", t, v + t) for e, values in {"A": [1.0, 2.0, 3.0, 10.0], "B": [5.0, 5.0], "C": [1.0], "D": [2.0]}.items() for i, v in enumerate(values) for t in (0, 1)]
    rows += [("A", "A_missing", 1, None), ("A", "A_nan", 1, NAN)]
    return spark.createDataFrame(rows, "entity string, future_id string, period int, v double")


@pytest.fixture(scope="module")
def caps(spark):
    return spark.createDataFrame(
        [("A", 4.0, 2.0, 1), ("A", 100.0, 100.0, 2), ("B", None, 6.0, 1), ("C", None, None, 1)],
        "entity string, low double, high double, o int",
    )


def test_cap_share_is_strict_and_skips_missing(ensemble, caps):
    got = {r["entity"]: r for r in probability.cap_share(ensemble, caps, 1, "v", ["low", "high"], keep_caps=True, cap_order=["o"]).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"]["n_futures"] == 4 and got["A"]["meets_low"] == 0.5 and got["A"]["meets_high"] == 0.0 and got["A"]["cap_low"] == 4.0
    assert got["B"]["meets_low"] is None and got["B"]["meets_high"] == 0.0


def test_q1_mean(ensemble):
    got = {r["entity"]: r["q1_mean"] for r in probability.q1_mean(ensemble, 1, "v").collect()}
    values = np.array([2.0, 3.0, 4.0, 11.0])
    assert got["A"] == pytest.approx(values[values <= np.quantile(values, 0.25)].mean()) and got["B"] == 6.0


def test_caps_from_base_keeps_entities_without_reference(spark):
    history = spark.createDataFrame([("A", 20, float(np.log1p(50))), ("B", 20, 0.0), ("A", 21, 9.0)], "entity string, period int, x double")
    reference = spark.createDataFrame([("A", -0.2), ("Z", 0.5)], "entity string, cut double")
    got = {r["entity"]: (r["base_value"], r["cap"]) for r in probability.caps_from_base(reference, history, 20, "x", {"cap": "cut"}).collect()}
    assert got["A"] == pytest.approx((50.0, 40.0)) and got["B"] == (0.0, None) and len(got) == 2


def test_headline_and_exceedance(spark):
    p = [0.0, 0.2, 0.5, 0.51, 1.0, None]
    table = spark.createDataFrame([(f"E{i}", v) for i, v in enumerate(p)], "entity string, p double")
    assert tuple(probability.headline(table, "p").first()) == (6, 2, pytest.approx(100 * 2 / 6))
    curve = probability.exceedance_curve(table, "p").toPandas().sort_values("step")
    known = np.array([v for v in p if v is not None])
    np.testing.assert_allclose(curve["share"], [(known >= t).mean() for t in np.linspace(0, 1, 200)])
    few = probability.exceedance_curve(table, "p", [0.9, 0.1]).toPandas().sort_values("step")
    assert few["share"].tolist() == [0.8, 0.2]
