import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import grouped


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows, with many ties."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 4000).round(2)] + [("tied", 3.0)] * 500
    rows += [(f"k{i % 20}", float(v)) for i, v in enumerate(rng.exponential(5, 900))] + [("k1", None), ("one", 7.0)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("max_group", [10, 1_000_000])
def test_quantiles_equal_numpy_in_both_routes(skewed, max_group):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in grouped.group_quantiles(skewed, ["k"], "v", probs, max_group=max_group).collect()}
    data = skewed.where("v is not null").toPandas().groupby("k")["v"]
    assert len(got) == data.ngroups
    for k, values in data:
        assert got[k]["n"] == len(values)
        np.testing.assert_allclose(got[k]["q"], np.quantile(values, probs), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("max_group", [10, 1_000_000])
def test_discrete_quantiles_are_order_statistics(skewed, max_group):
    probs = [0.2, 0.5, 0.75]
    got = grouped.group_quantiles(skewed, ["k"], "v", probs, discrete=True, max_group=max_group).collect()
    data = skewed.where("v is not null").toPandas().groupby("k")["v"]
    for r in got:
        values = np.sort(data.get_group(r["k"]).to_numpy())
        assert r["q"] == [values[max(int(np.ceil(p * len(values))), 1) - 1] for p in probs]


@pytest.mark.parametrize("max_group", [10, 1_000_000])
def test_quantiles_over_everything(skewed, max_group):
    got = grouped.group_quantiles(skewed, [], "v", [0.5], max_group=max_group).first()
    assert got["q"][0] == pytest.approx(np.median(skewed.where("v is not null").toPandas()["v"]))


@pytest.mark.parametrize("max_group", [10, 1_000_000])
def test_running_totals(skewed, max_group):
    per_value = skewed.where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    got = grouped.running_totals(per_value, ["k"], "v", {"upto": "c"}, max_group=max_group).toPandas().sort_values(["k", "v"])
    assert (got["upto"] == got.groupby("k")["c"].cumsum()).all() and len(got) == per_value.count()


def test_row_index_is_the_sorted_position(skewed):
    got = grouped.row_index(skewed.repartition(7), [F.col("v").asc_nulls_first(), "k"]).toPandas().sort_values("row_index")
    assert got["row_index"].tolist() == list(range(len(got)))
    assert got["v"].dropna().is_monotonic_increasing


def test_keep_first_uses_the_given_order(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None)], "k string, o int, x string")
    assert {(r["k"], r["x"]) for r in grouped.keep_first(df, ["k"], ["o"]).collect()} == {("a", "early"), ("b", None)}


def test_running_totals_split_a_hot_key_of_narrow_values(spark):
    """All values of the hot key lie between two values of the others."""
    rows = [("hot", 5.0 + i * 1e-6, 1) for i in range(3000)] + [(f"k{i % 5}", float(i), 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v double, c int")
    got = grouped.running_totals(df, ["k"], "v", {"upto": "c"}, max_group=10).toPandas().sort_values(["k", "v"])
    assert (got["upto"] == got.groupby("k")["c"].cumsum()).all() and len(got) == len(rows)
    whole = grouped.running_totals(df.where("k = 'hot'"), [], "v", {"upto": "c"}, max_group=10)
    assert whole.columns == ["k", "v", "c", "upto"] and whole.agg(F.max("upto")).first()[0] == 3000


def test_hot_key_of_equal_values(spark):
    df = spark.createDataFrame([("hot", 1.0)] * 2000 + [("hot", 2.0)] * 3 + [("b", 0.0)], "k string, v double")
    got = {r["k"]: r["q"] for r in grouped.group_quantiles(df, ["k"], "v", [0.5, 1.0], max_group=10).collect()}
    assert got == {"hot": [1.0, 2.0], "b": [0.0, 0.0]}


def test_a_row_takes_six_steps_to_its_bin(spark):
    rng = np.random.default_rng(3)
    splits = sorted(rng.integers(0, 40, grouped.SPLITS).astype(float).tolist())
    values = [*splits, *(rng.integers(-5, 90, 300) / 2).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("_splits", F.array(*[F.lit(x) for x in splits]))
    for r in df.select("v", grouped.bin_of("_splits", "v").alias("b")).collect():
        below = sum(x < r["v"] for x in splits)
        assert r["b"] == 2 * below + (below < len(splits) and splits[below] == r["v"])
    plan = df.select(grouped.bin_of("_splits", "v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[32,16,8,4,2,1]" in plan.replace(" ", "")  # the search's only loop


@pytest.mark.parametrize("range_rows", [3, 40, 1000])
def test_ranks_are_found_in_rounds(skewed, monkeypatch, range_rows):
    monkeypatch.setattr(grouped, "RANGE_ROWS", range_rows)
    probs = [0.0, 0.013, 0.25, 0.5, 0.987, 1.0]
    data = skewed.where("v is not null").toPandas().groupby("k")["v"]
    for discrete in (False, True):
        got = {r["k"]: r for r in grouped.group_quantiles(skewed, ["k"], "v", probs, discrete=discrete, max_group=2).collect()}
        for k, values in data:
            ordered = np.sort(values.to_numpy())
            want = [ordered[max(int(np.ceil(p * len(ordered))), 1) - 1] for p in probs] if discrete else np.quantile(ordered, probs)
            assert got[k]["n"] == len(ordered)
            np.testing.assert_allclose(got[k]["q"], want, rtol=1e-12, atol=1e-12)


def test_results_do_not_depend_on_partitioning(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, grouped.group_quantiles(skewed.repartition(int(n)), ["k"], "v", [0.25, 0.75], max_group=50).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
