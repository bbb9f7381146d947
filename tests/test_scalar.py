import hashlib
import math

from pyspark.sql import functions as F

from panelforge.functions import scalar
from panelforge.functions.aggregates import pearson, sample_skewness, share


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def out(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean_number_turns_bad_input_into_null(spark):
    text = column(spark, ["1.5", "n/a", None, "NaN", "Infinity"], "string")
    assert out(text, scalar.clean_number("x"))[:4] == [1.5, None, None, None]
    assert out(text, scalar.clean_number("x", finite=True)) == [1.5, None, None, None, None]


def test_clip_keeps_null(spark):
    assert out(column(spark, [-1.0, 0.5, 9.0, None]), scalar.clip("x", 0, 1)) == [0.0, 0.5, 1.0, None]


def test_signed_log_round_trip(spark):
    values = [-250.0, -0.5, 0.0, 3.0, 1e6]
    back = out(column(spark, values), scalar.signed_expm1(scalar.signed_log1p("x")))
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(back, values))


def test_stable_unit_equals_sha256_prefix(spark):
    df = spark.createDataFrame([("MEX", "id_MEX_1")], "e string, f string")
    got = df.select(scalar.stable_unit("e", "f", F.lit("switch"))).first()[0]
    digest = hashlib.sha256(b"MEX|id_MEX_1|switch").digest()
    assert got == int.from_bytes(digest[:8], "big") / 2.0**64


def test_standard_normal_has_unit_moments(spark):
    row = spark.range(20000).select(scalar.standard_normal("id").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03


def test_pct_change_and_comparison(spark):
    df = spark.createDataFrame([(0, -2.0, 1.0), (1, 0.0, 1.0), (2, 1.0, 1.0 + 1e-9), (3, 1.0, None)], "i int, s double, e double")
    assert out(df, scalar.pct_change("s", "e"))[:2] == [150.0, None]
    assert out(df, scalar.compare_close("e", "s")) == ["above", "above", "equal", None]


def test_lists_and_names(spark):
    df = spark.createDataFrame([(0, "a|b||c", "x__last")], "i int, l string, n string")
    assert out(df, scalar.parse_list("l")) == [["a", "b", "c"]]
    assert out(df, scalar.standard_name("n")) == ["x"]
    assert out(df, scalar.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")))) == [["b", "a", "c"]]
    assert scalar.slugify(" Lower middle-income ") == "lower_middle_income"


def test_guarded_aggregates(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 3.0), (4.0, 5.0, None), (None, 5.0, 9.0)], "a double, c double, b double")
    row = df.agg(pearson("a", "c").alias("constant"), pearson("a", "b").alias("r"), sample_skewness("a").alias("s"),
                 sample_skewness("c").alias("flat"), share(F.col("a") > 1).alias("p")).first()
    assert row["constant"] is None and math.isclose(row["r"], 1.0) and row["flat"] == 0.0 and row["p"] == 0.5
    assert math.isclose(row["s"], 0.9352195295828, rel_tol=1e-9)
