"""Time-series features, gap filling, smoothing, calibration and outlier removal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import calibrate, outliers, panel, smooth
from panelforge.plans.inputs import observed_futures, supplier_panel, user_days, with_sql
from panelforge.plans.registry import query, r, rounded

E = "OVER (PARTITION BY entity ORDER BY period)"


@query("lag_features", with_sql("panel") + f"""
SELECT entity, period, lag(revenue, 1) {E} AS revenue_lag1, lag(revenue, 2) {E} AS revenue_lag2, lag(revenue, 3) {E} AS revenue_lag3,
  lag(n_lines, 1) {E} AS n_lines_lag1, lag(n_lines, 2) {E} AS n_lines_lag2, lag(n_lines, 3) {E} AS n_lines_lag3 FROM panel""")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    return panel.add_lags(supplier_panel(spark, sf).select("entity", "period", "revenue", "n_lines"), ["revenue", "n_lines"]).drop("revenue", "n_lines")


@query("growth_features", with_sql("user_days") + f"""
, f AS (SELECT entity, period, last_value(amount IGNORE NULLS) {E} AS a FROM user_days)
SELECT entity, period, {r(f"a / nullif(lag(a) {E}, 0) - 1", "amount_growth_rate")} FROM f""")
def growth_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel.add_growth(user_days(spark, sf), ["amount"]).select("entity", "period", "amount_growth_rate"))




TREND3 = {"source": "revenue", "window": 3, "min_periods": 2, "shift": 1}
TREND5 = {"source": "revenue", "window": 5, "min_periods": 3, "shift": 1}
POS = "pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY period) AS DOUBLE) AS pos FROM "


def nested(name: str, window: int, enough: int, shift: int, fn: str, source: str, value: str = "revenue") -> str:
    """Rolling features by nested selects (DuckDB has no window inside a window)."""
    frame = f"OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    expr = f"regr_slope({value}, pos) {frame}" if fn == "slope" else f"stddev_samp({value}) {frame}"
    return f"{name}_raw AS (SELECT entity, period, CASE WHEN count({value}) {frame} >= {enough} THEN {expr} END AS x FROM {source}),\n{name} AS (SELECT entity, period, lag(x, {shift}) {E} AS {name} FROM {name}_raw)"


@query("rolling_slope", with_sql("panel", POS + "panel)", nested("t3", 3, 2, 1, "slope", "pos"), nested("t5", 5, 3, 1, "slope", "pos")) + f"""
SELECT entity, period, {r("t3", "trend_3")}, {r("t5", "trend_5")} FROM t3 JOIN t5 USING (entity, period)""")
def rolling_slope(spark: SparkSession, sf: str) -> DataFrame:
    out = panel.rolling_features(supplier_panel(spark, sf), {"trend_3": TREND3, "trend_5": TREND5})
    return rounded(out.select("entity", "period", "trend_3", "trend_5"))


@query("rolling_volatility", with_sql("user_days", POS + "user_days)", nested("v5", 5, 3, 1, "std", "pos", "amount")) + f"""
SELECT entity, period, {r("v5", "volatility_5")} FROM v5""")
def rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"source": "amount", "window": 5, "min_periods": 3, "shift": 1}
    return rounded(panel.rolling_features(user_days(spark, sf), None, {"volatility_5": spec}).select("entity", "period", "volatility_5"))


@query("trend_acceleration", with_sql("panel", POS + "panel)", nested("t3", 3, 2, 1, "slope", "pos"), nested("t5", 5, 3, 1, "slope", "pos")) + f"""
SELECT entity, period, {r("t3 - t5", "acceleration")} FROM t3 JOIN t5 USING (entity, period) WHERE t3 - t5 IS NOT NULL""")
def trend_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    out = panel.rolling_features(supplier_panel(spark, sf), {"t3": TREND3, "t5": TREND5}, None, {"acceleration": ("t3", "t5")})
    return rounded(out.select("entity", "period", "acceleration").where("acceleration is not null"))


GRID = """
grid AS (SELECT entity, CAST(unnest(generate_series(min(period), max(period))) AS INTEGER) AS period FROM user_days GROUP BY entity),
full_days AS (SELECT entity, period, amount, n_events FROM grid LEFT JOIN user_days USING (entity, period))"""


@query("gap_fill", with_sql("user_days", GRID) + "SELECT * FROM full_days")
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return panel.complete_periods(user_days(spark, sf))


INTERPOLATED = GRID + """,
near AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS pos FROM full_days),
ends AS (SELECT entity, period, amount, pos,
    last_value(CASE WHEN amount IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS bp, last_value(amount IGNORE NULLS) OVER b AS bv,
    first_value(CASE WHEN amount IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS ap, first_value(amount IGNORE NULLS) OVER a AS av
  FROM near WINDOW b AS (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
smooth AS (SELECT entity, period, pos, coalesce(amount, bv + (av - bv) * ((pos - bp) / nullif(CAST(ap - bp AS DOUBLE), 0)), bv, av) AS amount FROM ends)"""


@query("interpolate_linear", with_sql("user_days", INTERPOLATED) + f"""SELECT entity, period, {r("amount", "amount")} FROM smooth""")
def interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel.interpolate(panel.complete_periods(user_days(spark, sf)), ["amount"]).select("entity", "period", "amount"))


@query("fill_by_group", with_sql("user_days", GRID) + """
SELECT entity, period, coalesce(last_value(amount IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(amount IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS amount FROM full_days""")
def fill_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return panel.fill_within_group(panel.complete_periods(user_days(spark, sf)), ["amount"]).select("entity", "period", "amount")


@query("value_at_period", with_sql("user_days") + """
SELECT entity, coalesce(max(CASE WHEN period = 15 THEN amount END), arg_max(amount, period) FILTER (WHERE amount IS NOT NULL)) AS amount,
  coalesce(max(CASE WHEN period = 15 THEN n_events END), arg_max(n_events, period)) AS n_events FROM user_days GROUP BY entity""")
def value_at_period(spark: SparkSession, sf: str) -> DataFrame:
    return panel.value_at_period(user_days(spark, sf), ["amount", "n_events"], 15)


def weight_rows(penalty: float, lengths: range) -> str:
    """Rows ``(n, i, j, w)`` of the smoother matrices as a SQL VALUES list, from a dense inverse."""
    rows = []
    for n in lengths:
        d = np.diff(np.eye(n), 2, axis=0)
        inverse = np.linalg.inv(np.eye(n) + penalty * d.T @ d)
        rows += [f"({n},{i + 1},{j + 1},{float(inverse[i, j])!r}::DOUBLE)" for i in range(n) for j in range(n)]
    return "w(n, i, j, w) AS (VALUES " + ",".join(rows) + ")"


HP_DAYS = INTERPOLATED + """,
len AS (SELECT entity, count(amount) AS n FROM smooth GROUP BY entity),
hp AS (SELECT a.entity, a.period, any_value(a.amount) AS amount, sum(w.w * b.amount) AS trend
  FROM smooth a JOIN len ON a.entity = len.entity JOIN smooth b ON a.entity = b.entity JOIN w ON w.n = len.n AND w.i = a.pos AND w.j = b.pos
  WHERE len.n >= 6 GROUP BY a.entity, a.period)"""


@query("hp_trend", with_sql("user_days", weight_rows(100.0, range(24, 31)), HP_DAYS) + f"""
SELECT entity, period, {r("trend", "amount_hp_trend", 4)} FROM smooth LEFT JOIN hp USING (entity, period)""")
def hp_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = smooth.hp_filter(panel.complete_periods(user_days(spark, sf)), ["amount"])
    return rounded(out.select("entity", "period", "amount_hp_trend"), 4)


@query("hp_cycle", with_sql("user_days", weight_rows(100.0, range(24, 31)), HP_DAYS) + f"""
SELECT entity, period, {r("hp.amount - trend", "amount", 4)} FROM smooth LEFT JOIN hp USING (entity, period)""")
def hp_cycle(spark: SparkSession, sf: str) -> DataFrame:
    out = smooth.hp_filter(panel.complete_periods(user_days(spark, sf)), ["amount"], which="cycle", keep="replace")
    return rounded(out.select("entity", "period", "amount"), 4)


BASE_YEAR = 1996
INITIAL = """
initial AS (SELECT entity, CAST(1996 AS INTEGER) AS period, CAST(floor(avg(value)) AS DOUBLE) AS value, CAST(floor(avg(n_orders) * 2) AS DOUBLE) AS n_orders, CAST(floor(avg(cum_orders)) AS DOUBLE) AS total FROM futures WHERE period = 1996 GROUP BY entity),
based AS (SELECT futures.*, initial.value AS iv, initial.n_orders AS io, initial.total AS it,
  max(CASE WHEN futures.period = 1996 THEN futures.value END) OVER s AS bv, max(CASE WHEN futures.period = 1996 THEN futures.n_orders END) OVER s AS bo,
  max(CASE WHEN futures.period = 1996 THEN futures.cum_orders END) OVER s AS bc
  FROM futures LEFT JOIN initial ON futures.entity = initial.entity WINDOW s AS (PARTITION BY futures.entity, futures.future_id))"""


def initial_state(futures: DataFrame) -> DataFrame:
    """Observed base-period state per nation, from the futures' averages."""
    return futures.where(F.col("period") == BASE_YEAR).groupBy("entity").agg(
        F.lit(BASE_YEAR).alias("period"), F.floor(F.avg("value")).cast("double").alias("value"),
        F.floor(F.avg("n_orders") * 2).cast("double").alias("n_orders"), F.floor(F.avg("cum_orders")).cast("double").alias("total"),
    )


@query("calibrate_additive", with_sql("futures", INITIAL) + "SELECT entity, future_id, period, iv + (value - bv) AS value FROM based")
def calibrate_additive(spark: SparkSession, sf: str) -> DataFrame:
    futures = observed_futures(spark, sf)
    out = calibrate.calibrate(futures, initial_state(futures), BASE_YEAR, ["value"], method="additive")
    return out.select("entity", "future_id", "period", "value")


@query("calibrate_multiplicative", with_sql("futures", INITIAL) + f"SELECT entity, future_id, period, {r('iv * (value / nullif(bv, 0))', 'value')} FROM based")
def calibrate_multiplicative(spark: SparkSession, sf: str) -> DataFrame:
    futures = observed_futures(spark, sf)
    out = calibrate.calibrate(futures, initial_state(futures), BASE_YEAR, ["value"])
    return rounded(out.select("entity", "future_id", "period", "value"))


@query("calibrate_multi", with_sql("futures", INITIAL) + f"""
, c AS (SELECT entity, future_id, period, iv * (value / nullif(bv, 0)) AS value, io + (n_orders - bo) AS n_orders, it * (cum_orders / nullif(bc, 0)) AS cum_orders FROM based)
SELECT entity, future_id, period, {r("value", "value")}, {r("n_orders", "n_orders")}, {r("cum_orders", "cum_orders")},
  {r("CASE WHEN value > 0 THEN ln(value) END", "log_value")} FROM c""")
def calibrate_multi(spark: SparkSession, sf: str) -> DataFrame:
    futures = observed_futures(spark, sf).withColumn("log_value", F.lit(0.0))
    mapping = {"value": "value", "n_orders": "n_orders", "total": "cum_orders"}
    out = calibrate.calibrate(futures, initial_state(futures), BASE_YEAR, column_map=mapping, method={"value": "multiplicative", "n_orders": "additive"})
    return rounded(out.select("entity", "future_id", "period", "value", "n_orders", "cum_orders", "log_value"))


@query("iqr_series_filter", with_sql("futures") + """
, q AS (SELECT entity, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM futures WHERE period = 2000 GROUP BY entity),
o AS (SELECT entity, future_id FROM futures JOIN q USING (entity) WHERE period = 2000 AND n >= 5 AND q3 > q1 AND (value < q1 - 1.0 * (q3 - q1) OR value > q3 + 1.0 * (q3 - q1)))
SELECT entity, future_id, period, value FROM futures WHERE future_id NOT IN (SELECT future_id FROM o)""")
def iqr_series_filter(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.remove_outlier_series(observed_futures(spark, sf), 2000, "value", multiplier=1.0).select("entity", "future_id", "period", "value")


@query("iqr_removed_series", with_sql("futures") + """
, q AS (SELECT entity, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM futures WHERE period = 2000 GROUP BY entity)
SELECT entity, future_id FROM futures JOIN q USING (entity) WHERE period = 2000 AND n >= 5 AND q3 > q1 AND (value < q1 - 1.0 * (q3 - q1) OR value > q3 + 1.0 * (q3 - q1))""")
def iqr_removed_series(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.removed_series(observed_futures(spark, sf), 2000, "value", multiplier=1.0)
