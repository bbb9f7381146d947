"""Simulated ensembles and path constraints."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.ensemble import EnsembleConfig, generate_ensemble, trend_line
from panelforge.operators.profile import long_format
from panelforge.operators.rules import apply_rules, category_column
from panelforge.plans.inputs import (
    CONSTRAINED,
    DRIFT,
    END_PERIOD,
    RULES,
    SCENARIOS,
    VARIABLES,
    observed_futures,
    supplier_panel,
    with_sql,
)
from panelforge.plans.registry import query, r, rounded


def unit(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def simulated_sql(v: str, source: str = "panel", ar1: bool = False, blend: float = 0.0, window: int = 5, clip: float = 1.0, scale: float = 1.0, n: int = SCENARIOS, end: int = END_PERIOD) -> str:
    """CTEs ending in ``sim_<v>(entity, future_id, period, h, <v>)``."""
    spread = f"""sd * sqrt(1 - phi * phi) * coalesce((SELECT sum(j.e * (1 - pow(phi, x.h - j.h + 1)) / (1 - phi)) FROM draw_{v} j
        WHERE j.entity = x.entity AND j.future_id = x.future_id AND j.h <= x.h), 0)""" if ar1 else "sd * total"
    memory = "(d0 - mu) * phi * (1 - pow(phi, x.h)) / (1 - phi)" if ar1 else "0"
    path = f"CASE WHEN ok THEN greatest(coalesce(last + x.h * mu + {memory} + {spread}, last), -50) ELSE last + 0.002::DOUBLE * e END"
    line = f"last + least(greatest(slope, -{clip}), {clip}) * x.h"
    if blend:
        path = f"CASE WHEN slope IS NULL THEN {path} ELSE (1 - {blend}::DOUBLE) * ({path}) + {blend}::DOUBLE * ({line}) END"
    if scale != 1.0:
        path = f"last + (({path}) - last) * {scale}::DOUBLE"
    return f"""
d_{v} AS (SELECT entity, period, {v} AS v, {v} - lag({v}) OVER w AS d, row_number() OVER w AS pos,
    row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS back, min({v}) OVER (PARTITION BY entity) AS lo, max({v}) OVER (PARTITION BY entity) AS hi
  FROM {source} WHERE {v} IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY period)),
dl_{v} AS (SELECT *, lag(d) OVER (PARTITION BY entity ORDER BY period) AS dl FROM d_{v}),
fit_{v} AS (SELECT entity, max(period) AS last_t, arg_max(v, period) AS last, avg(d) AS mu, stddev_samp(d) AS sd,
    count(*) >= 10 AND bool_or(v > lo AND v < hi) AS ok, regr_slope(v, CAST(pos AS DOUBLE)) FILTER (WHERE back <= {window}) AS slope,
    coalesce(least(greatest(regr_slope(d, dl), -0.95), 0.95), 0) AS phi, arg_max(d, period) AS d0 FROM dl_{v} GROUP BY entity),
steps_{v} AS (SELECT fit_{v}.*, 'id_' || entity || '_' || s AS future_id, CAST(h AS INTEGER) AS h FROM fit_{v}, generate_series(1, {n}) t(s), generate_series(0, 60) u(h) WHERE h <= greatest({end} - last_t, 0)),
draw_{v} AS (SELECT *, CASE WHEN h >= 1 THEN sqrt(-2 * ln(greatest({unit("entity", "future_id", f"'{v}'", "CAST(h AS VARCHAR)", "'a'")}, 1 / 18446744073709551616.0::DOUBLE)))
    * cos(6.283185307179586::DOUBLE * {unit("entity", "future_id", f"'{v}'", "CAST(h AS VARCHAR)", "'b'")}) END AS e FROM steps_{v}),
tot_{v} AS (SELECT *, sum(e) OVER (PARTITION BY entity, future_id ORDER BY h) AS total FROM draw_{v}),
sim_{v} AS (SELECT entity, future_id, CAST(last_t + h AS INTEGER) AS period, h, CASE WHEN h = 0 THEN last ELSE {path} END AS {v} FROM tot_{v} x)"""


@query("ensemble_drift", with_sql("panel", simulated_sql("revenue"), simulated_sql("net_margin")) + f"""
SELECT entity, future_id, period, {r("revenue", "revenue")}, {r("net_margin", "net_margin")} FROM sim_revenue JOIN sim_net_margin USING (entity, future_id, period)""")
def ensemble_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), DRIFT, ["revenue", "net_margin"]))


@query("ensemble_ar1", with_sql("panel", simulated_sql("revenue", ar1=True)) + f"""
SELECT entity, future_id, period, {r("revenue", "revenue")} FROM sim_revenue""")
def ensemble_ar1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), replace(DRIFT, increments="ar1"), ["revenue"]))


SHORT = "short AS (SELECT entity, period, revenue, CASE WHEN revenue > 0 THEN 7.0::DOUBLE END AS flat FROM panel WHERE period < 6)"


@query("ensemble_short_history", with_sql("panel", SHORT, simulated_sql("revenue", "short", n=5, end=8), simulated_sql("flat", "short", n=5, end=8)) + f"""
SELECT entity, future_id, period, {r("revenue", "revenue")}, {r("flat", "flat")} FROM sim_revenue JOIN sim_flat USING (entity, future_id, period) WHERE period > 5""")
def ensemble_short_history(spark: SparkSession, sf: str) -> DataFrame:
    early = supplier_panel(spark, sf).where("period < 6").select("entity", "period", "revenue", F.when(F.col("revenue") > 0, 7.0).alias("flat"))
    out = generate_ensemble(early, EnsembleConfig(end_period=8, n_scenarios=5, include_baseline=False), ["revenue", "flat"])
    return rounded(out.where("period > 5"))


BLENDED = replace(DRIFT, default_blend=0.2, blend={"revenue": 0.6}, scale={"net_margin": 0.1}, trend_window=6, slope_clip=20.0)


@query("ensemble_trend_blend", with_sql("panel", simulated_sql("revenue", blend=0.6, window=6, clip=20.0), simulated_sql("net_margin", blend=0.2, window=6, clip=20.0, scale=0.1)) + f"""
SELECT entity, future_id, period, {r("revenue", "revenue")}, {r("net_margin", "net_margin")} FROM sim_revenue JOIN sim_net_margin USING (entity, future_id, period)""")
def ensemble_trend_blend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), BLENDED, ["revenue", "net_margin"]))


@query("trend_line", with_sql("panel", simulated_sql("revenue", window=6)) + f"""
SELECT entity, CAST(step AS INTEGER) AS step, {r("last + least(greatest(slope, -20), 20) * step", "trend")} FROM fit_revenue, generate_series(1, 8) t(step)""")
def trend_line_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trend_line(supplier_panel(spark, sf), "revenue", 8, 6, 20.0))


SEAM = replace(
    DRIFT, n_scenarios=8,
    constants={"anchor_24": 24}, constant_sources={"anchor_24": "revenue"}, years_since={"since_24": 24},
    products={"trend_since": ("trend_5", "since_24")},
    lags={"lag_1": "revenue", "guided_lag": {"source": "revenue", "anchor": "anchor_24", "trend": "trend_5", "years_since": "since_24", "blend": 0.8}},
    slopes={"trend_3": {"source": "revenue", "window": 3, "min_periods": 2, "shift": 1}, "trend_5": {"source": "revenue", "window": 5, "min_periods": 3, "shift": 1}},
    stds={"volatility_5": {"source": "revenue", "window": 5, "min_periods": 3, "shift": 1}},
    differences={"acceleration": ("trend_3", "trend_5")},
    scale={"trend_3": 0.1, "volatility_5": 0.5, "lag_1": 0.1, "acceleration": 0.1},
)
FRAME = "OVER (PARTITION BY entity, future_id ORDER BY period ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
F3, F5 = FRAME.format(2), FRAME.format(4)
HE, FE = "OVER (PARTITION BY entity ORDER BY period)", "OVER (PARTITION BY entity, future_id ORDER BY period)"
SEAM_SQL = f"""
hist AS (SELECT entity, period, revenue, CAST(row_number() {HE} AS DOUBLE) AS pos, lag(revenue) {HE} AS hl, max(period) OVER (PARTITION BY entity) AS end_t FROM panel),
seam AS (SELECT s.entity, s.future_id, h.period, -1 AS h, h.revenue FROM (SELECT DISTINCT entity, future_id FROM sim_revenue) s JOIN hist h ON s.entity = h.entity AND h.period < h.end_t
  UNION ALL SELECT entity, future_id, period, h, revenue FROM sim_revenue),
pos AS (SELECT *, CAST(row_number() {FE} AS DOUBLE) AS pos FROM seam),
raw AS (SELECT *, CASE WHEN count(revenue) {F3} >= 2 THEN regr_slope(revenue, pos) {F3} END AS s3, CASE WHEN count(revenue) {F5} >= 3 THEN regr_slope(revenue, pos) {F5} END AS s5,
  CASE WHEN count(revenue) {F5} >= 3 THEN stddev_samp(revenue) {F5} END AS v5 FROM pos),
moved AS (SELECT entity, future_id, period, h, revenue, lag(s3) {FE} AS t3, lag(s5) {FE} AS t5, lag(v5) {FE} AS v5 FROM raw),
hraw AS (SELECT *, CASE WHEN count(revenue) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 THEN regr_slope(revenue, pos) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS s3,
  CASE WHEN count(revenue) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN stddev_samp(revenue) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS v5 FROM hist),
hmoved AS (SELECT *, lag(s3) {HE} AS t3, lag(v5) {HE} AS v5m FROM hraw),
anchors AS (SELECT entity, arg_max(t3, period) FILTER (WHERE t3 IS NOT NULL) AS a3, arg_max(v5m, period) FILTER (WHERE v5m IS NOT NULL) AS av, arg_max(hl, period) FILTER (WHERE hl IS NOT NULL) AS al,
  coalesce(max(CASE WHEN period = end_t - 1 THEN revenue END), arg_max(revenue, period)) AS seed, coalesce(max(CASE WHEN period = 24 THEN revenue END), arg_max(revenue, period)) AS c24 FROM hmoved GROUP BY entity),
feat AS (SELECT m.entity, future_id, period, h, revenue, c24, CAST(period - 24 AS DOUBLE) AS since, a3 + (t3 - a3) * 0.1::DOUBLE AS t3, t5, CASE WHEN av IS NULL THEN v5 ELSE av + (v5 - av) * 0.5::DOUBLE END AS v5, al, seed FROM moved m JOIN anchors a ON m.entity = a.entity WHERE h >= 0),
feat2 AS (SELECT *, lag(revenue) {FE} AS lr, lag(0.8::DOUBLE * (c24 + t5 * since) + (1 - 0.8::DOUBLE) * revenue) {FE} AS lg, max(CASE WHEN h = 0 THEN t3 - t5 END) OVER (PARTITION BY entity, future_id) AS acc0 FROM feat)"""


@query("ensemble_seam_features", with_sql("panel", simulated_sql("revenue", n=8), SEAM_SQL) + f"""
SELECT entity, future_id, period, {r("revenue", "revenue")}, {r("c24", "anchor_24")}, {r("since", "since_24")}, {r("t5 * since", "trend_since")},
  {r("al + ((CASE WHEN h = 0 THEN seed ELSE lr END) - al) * 0.1::DOUBLE", "lag_1")}, {r("CASE WHEN h = 0 THEN seed ELSE lg END", "guided_lag")},
  {r("t3", "trend_3")}, {r("t5", "trend_5")}, {r("v5", "volatility_5")}, {r("CASE WHEN acc0 IS NULL THEN t3 - t5 ELSE acc0 + (t3 - t5 - acc0) * 0.1::DOUBLE END", "acceleration")} FROM feat2""")
def ensemble_seam_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), SEAM, ["revenue"]))


@query("rules_clip_round", with_sql("panel", *[simulated_sql(v) for v in ("revenue", "n_lines", "avg_discount", "return_share")]) + f"""
SELECT entity, future_id, period, {r("greatest(revenue, 0)", "revenue")}, {r("greatest(round_even(n_lines, 0), 0)", "n_lines")},
  {r("least(greatest(avg_discount, 0), 1)", "avg_discount")}, {r("least(greatest(return_share, 0), 1)", "return_share")}
FROM sim_revenue JOIN sim_n_lines USING (entity, future_id, period) JOIN sim_avg_discount USING (entity, future_id, period) JOIN sim_return_share USING (entity, future_id, period)""")
def rules_clip_round(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), CONSTRAINED, ["revenue", "n_lines", "avg_discount", "return_share"]))


@query("rules_monotone", with_sql("panel", simulated_sql("cum_lines")) + f"""
SELECT entity, future_id, period, {r("max(greatest(round_even(cum_lines, 0), 0)) OVER (PARTITION BY entity, future_id ORDER BY period)", "cum_lines")} FROM sim_cum_lines""")
def rules_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), CONSTRAINED, ["cum_lines"]))


SIGNED = "signed AS (SELECT entity, period, sign(revenue - 700) * ln(1 + abs(revenue - 700)) AS x_log_signed_revenue FROM panel)"


@query("rules_signed_log", with_sql("panel", SIGNED, simulated_sql("x_log_signed_revenue", "signed")) + f"""
, lev AS (SELECT *, greatest(sign(x_log_signed_revenue) * (exp(abs(x_log_signed_revenue)) - 1), 0) AS lv FROM sim_x_log_signed_revenue)
SELECT entity, future_id, period, {r("sign(lv) * ln(1 + abs(lv))", "x_log_signed_revenue")} FROM lev""")
def rules_signed_log(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.col("revenue") - 700
    signed = supplier_panel(spark, sf).select("entity", "period", (F.signum(shifted) * F.log1p(F.abs(shifted))).alias("x_log_signed_revenue"))
    return rounded(generate_ensemble(signed, CONSTRAINED, ["x_log_signed_revenue"]))


@query("rules_binary_switch", with_sql("panel", simulated_sql("has_bulk")) + f"""
, lat AS (SELECT entity, future_id, period, h, least(greatest(has_bulk, 0), 1) AS latent FROM sim_has_bulk),
st AS (SELECT *, round_even(latent, 0) AS state, first_value(round_even(latent, 0)) OVER (PARTITION BY entity, future_id ORDER BY period) AS start FROM lat),
agg AS (SELECT entity, future_id, any_value(start) AS start, max(h) AS n, avg(CASE WHEN h > 0 THEN latent END) AS mean,
    min(CASE WHEN h > 0 AND ((start = 0 AND latent >= 0.65) OR (start = 1 AND latent <= 0.35)) THEN h END) AS crossing FROM st GROUP BY entity, future_id),
sw AS (SELECT *, coalesce(crossing, CASE WHEN {unit("entity", "future_id", "'has_bulk'", "'switch'")} <
    least(0.45, 0.02 + 0.9 * greatest(CASE WHEN start = 0 THEN mean - 0.5 ELSE 0.5 - mean END, 0)) THEN floor({unit("entity", "future_id", "'has_bulk'", "'switch_year'")} * n) + 1 END) AS switch_at FROM agg)
SELECT st.entity, st.future_id, period, CASE WHEN switch_at IS NOT NULL AND h >= switch_at THEN 1 - sw.start ELSE sw.start END AS has_bulk FROM st JOIN sw ON st.entity = sw.entity AND st.future_id = sw.future_id""")
def rules_binary_switch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(generate_ensemble(supplier_panel(spark, sf), CONSTRAINED, ["has_bulk"]))


@query("rule_categories", with_sql("panel") + """
, long AS (SELECT variable, value FROM (SELECT revenue, n_lines, avg_discount, return_share, has_bulk, cum_lines, net_margin, revenue AS x_log_signed_revenue, net_margin AS log_net_margin FROM panel)
  UNPIVOT (value FOR variable IN (revenue, n_lines, avg_discount, return_share, has_bulk, cum_lines, net_margin, x_log_signed_revenue, log_net_margin)))
SELECT variable, CASE WHEN variable IN ('revenue', 'x_log_signed_revenue') THEN 'non_negative' WHEN variable = 'n_lines' THEN 'count' WHEN variable LIKE 'avg\\_%' ESCAPE '\\' THEN 'bounded_0_1'
  WHEN variable = 'return_share' THEN 'bounded_0_1' WHEN variable = 'has_bulk' THEN 'binary' WHEN variable = 'cum_lines' THEN 'cumulative_count' WHEN variable LIKE 'log\\_%' ESCAPE '\\' THEN 'log_unbounded' ELSE 'unconstrained' END AS category,
  CASE WHEN variable = 'revenue' THEN 'non_negative' WHEN variable = 'n_lines' THEN 'count' WHEN variable LIKE 'avg\\_%' ESCAPE '\\' THEN 'bounded_0_1'
  WHEN variable = 'return_share' THEN 'bounded_0_1' WHEN variable = 'has_bulk' THEN 'binary' WHEN variable = 'cum_lines' THEN 'cumulative_count' WHEN variable LIKE 'log\\_%' ESCAPE '\\' THEN 'log_unbounded' ELSE 'unconstrained' END AS own_category,
  count(*) AS n_values FROM long GROUP BY variable""")
def rule_categories(spark: SparkSession, sf: str) -> DataFrame:
    wide = supplier_panel(spark, sf).withColumns({"x_log_signed_revenue": F.col("revenue"), "log_net_margin": F.col("net_margin")})
    rows = long_format(wide, [*VARIABLES, "x_log_signed_revenue", "log_net_margin"])
    named = rows.select("variable", category_column(RULES).alias("category"), category_column(RULES, inherit_signed_log=False).alias("own_category"))
    return named.groupBy("variable", "category", "own_category").agg(F.count(F.lit(1)).alias("n_values"))


@query("rules_observed", with_sql("futures") + f"""
SELECT entity, future_id, period, {r("greatest(round_even(n_orders * 1.5 - 2, 0), 0)", "n_orders")},
  {r("max(greatest(round_even(cum_orders * 0.75, 0), 0)) OVER (PARTITION BY entity, future_id ORDER BY period)", "cum_orders")}, {r("greatest(max_order - 100, 0)", "max_order")} FROM futures""")
def rules_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, running counts and non-negative values of observed futures, brought within their rules."""
    paths = observed_futures(spark, sf).select(
        "entity", "future_id", "period", (F.col("n_orders") * 1.5 - 2.0).alias("n_orders"), (F.col("cum_orders") * 0.75).alias("cum_orders"), (F.col("max_order") - 100.0).alias("max_order"),
    )
    return rounded(apply_rules(paths, ["n_orders", "cum_orders", "max_order"], RULES))
