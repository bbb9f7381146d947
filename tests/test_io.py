import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from panelforge.operators import cleaning
from panelforge.sources import io


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("A", 1, 1.5), ("B", 2, float("nan")), ("B", 3, None)], "entity string, period int, v double")


def test_parquet_and_csv_round_trip(spark, table, tmp_path):
    io.write_parquet(table, f"{tmp_path}/t", ["entity"])
    back = io.read_parquet(spark, f"{tmp_path}/t")
    assert back.where("v is null").count() == 2 and back.where("isnan(v)").count() == 0
    io.write_csv(table.select("entity", "period", "v"), f"{tmp_path}/c")
    csv = io.read_csv(spark, f"{tmp_path}/c", "entity string, period int, v double")
    assert csv.where("v is null").count() == 2 and csv.count() == 3
    pruned = io.read_parquet(spark, f"{tmp_path}/t").where("entity = 'A'")
    assert "PartitionFilters: [isnotnull(entity" in pruned._jdf.queryExecution().toString()


def test_bundles(spark, table, tmp_path):
    tables = {"one": table, "nested": {"E1": {"two": table.limit(1)}}}
    for fmt in ("parquet", "csv"):
        io.save_bundle(tables, f"{tmp_path}/{fmt}", fmt)
        back = io.load_bundle(spark, f"{tmp_path}/{fmt}", {"one": "entity string, period int, v double"})
        assert back["one"].count() == 3 and back["nested"]["E1"]["two"].count() == 1
    with pytest.raises(ValueError):
        io.save_bundle(tables, f"{tmp_path}/x", "xlsx")
    with pytest.raises(TypeError):
        io.save_bundle({"bad": 3}, f"{tmp_path}/y")
    with pytest.raises(FileNotFoundError):
        io.load_bundle(spark, f"{tmp_path}/none")


def test_run_tables(spark, table, tmp_path):
    base, cache = f"{tmp_path}/runs", f"{tmp_path}/cache"
    io.save_run_table(table, base, "ensemble", 7)
    got = io.load_run_tables(spark, base, 7, ["ensemble"], ["B"], cache, refresh=True)
    assert got["ensemble"].count() == 2
    # The copy holds the whole run, whatever was selected when it was written.
    assert io.load_run_tables(spark, base, 7, ["ensemble"], cache=cache)["ensemble"].count() == 3
    assert io.load_run_tables(spark, base, 7, ["ensemble"], ["A"], cache=cache)["ensemble"].count() == 1
    io.save_run_table(table.where("entity = 'A'"), base, "ensemble", 8)
    with pytest.raises(FileNotFoundError, match="copy of run 8"):
        io.load_run_tables(spark, base, 8, ["ensemble"], cache=cache)
    assert io.load_run_tables(spark, base, 8, ["ensemble"], cache=cache, refresh=True)["ensemble"].count() == 1
    assert io.load_run_tables(spark, base, 7, ["ensemble"], cache=cache)["ensemble"].count() == 3
    with pytest.raises(FileNotFoundError, match="caps"):
        io.load_run_tables(spark, base, 7, ["ensemble", "caps"], cache=cache)
    with pytest.raises(FileNotFoundError, match="caps"):
        io.load_run_tables(spark, base, 7, ["ensemble", "caps"])


def test_models_are_kept_unless_rewritten(spark, table, tmp_path):
    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, v * 2 AS w FROM __THIS__")]).fit(table)
    assert io.save_model(model, f"{tmp_path}/m") and not io.save_model(model, f"{tmp_path}/m") and io.save_model(model, f"{tmp_path}/m", rewrite=True)
    assert io.load_model(f"{tmp_path}/m").transform(table).where("w = 3").count() == 1


def test_reference_table(spark, tmp_path):
    raw = spark.createDataFrame([(" mex", 1.0), ("USA", 2.0), (None, 3.0)], "iso string, u double")
    raw.write.parquet(f"{tmp_path}/caps")
    got = io.read_reference(spark, f"{tmp_path}/caps", "iso", {"u": "unconditional"})
    assert {tuple(r) for r in got.collect()} == {("MEX", 1.0), ("USA", 2.0)}
    spark.createDataFrame([("A", None), ("A", 2.0), ("B", 1.0), ("B", None), ("a", 9.0)], "iso string, u double").coalesce(1).write.parquet(f"{tmp_path}/gaps")
    got = io.read_reference(spark, f"{tmp_path}/gaps", "iso", {"u": "u"})
    assert {tuple(r) for r in got.collect()} == {("A", None), ("B", 1.0)}
    with pytest.raises(ValueError, match="missing"):
        io.read_reference(spark, f"{tmp_path}/caps", "iso", {"missing": "x"})


def test_selection_and_cleaning(spark, table):
    assert cleaning.select_entities(table, ["b"]).count() == 2 and cleaning.select_entities(table, None).count() == 3
    with pytest.raises(ValueError, match="ZZZ"):
        cleaning.select_entities(table, ["A", "zzz"])
    wide = table.withColumns({"zero": F.lit(0.0), "zero_or_null": F.when(F.col("period") > 1, 0.0), "none": F.lit(None).cast("double")})
    assert cleaning.drop_all_zero(wide, ["zero", "zero_or_null", "none"]).columns == ["entity", "period", "v", "zero_or_null", "none"]
    assert "none" not in cleaning.drop_all_null(wide, ["v", "none"]).columns
    hot = cleaning.one_hot(table, ["entity"])
    assert hot.columns == ["period", "v", "entity_A", "entity_B"] and [tuple(r)[2:] for r in hot.orderBy("period").collect()] == [(1, 0), (0, 1), (0, 1)]
    vector, levels = cleaning.one_hot_vector(table.withColumn("kind", F.when(F.col("entity") == "B", F.lit("x"))), ["entity", "kind"])
    assert levels == {"entity": ["A", "B"], "kind": ["x"]} and vector.columns == ["period", "v", "features"]
    assert [r["features"].toArray().tolist() for r in vector.orderBy("period").collect()] == [[1, 0, 0], [0, 1, 1], [0, 1, 1]]
    assert [r["features"].toArray().tolist() for r in cleaning.one_hot_vector(table, ["entity"], drop_first=True)[0].orderBy("period").collect()] == [[0], [1], [1]]
    assert cleaning.drop_missing(cleaning.clean_numbers(table, ["v"]), ["v"]).count() == 1
