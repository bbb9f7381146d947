"""Caps, probabilities and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.scalar import signed_log1p
from panelforge.operators import probability, vulnerability
from panelforge.operators.ensemble import generate_ensemble
from panelforge.operators.profile import histogram
from panelforge.plans.ensemble_queries import simulated_sql
from panelforge.plans.inputs import (
    BASE_PERIOD,
    DRIFT,
    END_PERIOD,
    cap_reference,
    gappy_caps,
    nation_caps,
    observed_futures,
    supplier_panel,
    with_sql,
)
from panelforge.plans.registry import query, r, rounded
from panelforge.session import staged

CAPS = ["unconditional", "conditional"]
CAPS_SQL = f"""
caps AS (SELECT p.entity, exp(ln(1 + revenue)) - 1 AS base_value, (1 + unconditional_rel) * (exp(ln(1 + revenue)) - 1) AS unconditional, (1 + conditional_rel) * (exp(ln(1 + revenue)) - 1) AS conditional
  FROM panel p LEFT JOIN cap_reference c ON p.entity = c.entity WHERE p.period = {BASE_PERIOD})"""
SHARE_SQL = f"""
ev AS (SELECT s.entity, future_id, revenue, unconditional, conditional FROM sim_revenue s JOIN caps c ON s.entity = c.entity WHERE s.period = {END_PERIOD} AND coalesce(unconditional, conditional) IS NOT NULL),
shares AS (SELECT entity, count(DISTINCT future_id) AS n_futures, avg(CASE WHEN revenue < unconditional THEN 1 WHEN unconditional IS NOT NULL THEN 0 END) AS meets_unconditional,
  avg(CASE WHEN revenue < conditional THEN 1 WHEN conditional IS NOT NULL THEN 0 END) AS meets_conditional FROM ev GROUP BY entity)"""
LOW_SQL = f"""
cut AS (SELECT entity, quantile_cont(revenue, 0.25) AS q FROM sim_revenue WHERE period = {END_PERIOD} GROUP BY entity),
low AS (SELECT s.entity, avg(revenue) AS q1_mean FROM sim_revenue s JOIN cut ON s.entity = cut.entity AND revenue <= q WHERE period = {END_PERIOD} GROUP BY s.entity)"""
SIM = simulated_sql("revenue")


def caps(spark: SparkSession, sf: str) -> DataFrame:
    history = supplier_panel(spark, sf).select("entity", "period", signed_log1p("revenue").alias("x_log_signed_revenue"))
    out = probability.caps_from_base(
        cap_reference(spark, sf), history, BASE_PERIOD, "x_log_signed_revenue",
        {"unconditional": "unconditional_rel", "conditional": "conditional_rel"},
    )
    return out.select("entity", "base_value", *CAPS)


def simulated(spark: SparkSession, sf: str) -> DataFrame:
    return generate_ensemble(supplier_panel(spark, sf), DRIFT, ["revenue"])


def shares(spark: SparkSession, sf: str) -> DataFrame:
    return probability.cap_share(simulated(spark, sf), caps(spark, sf), END_PERIOD, "revenue", CAPS)


@query("cap_targets", with_sql("panel", "cap_reference", CAPS_SQL) + f"""
SELECT entity, {r("base_value", "base_value")}, {r("unconditional", "unconditional")}, {r("conditional", "conditional")} FROM caps""")
def cap_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(caps(spark, sf))


@query("cap_share", with_sql("panel", "cap_reference", SIM, CAPS_SQL, SHARE_SQL) + f"""
SELECT entity, n_futures, {r("meets_unconditional", "meets_unconditional")}, {r("meets_conditional", "meets_conditional")} FROM shares""")
def cap_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shares(spark, sf))


@query("cap_share_repeated_caps", with_sql("futures", "nation_caps") + f"""
, one AS (SELECT upper(entity) AS entity, cap_value * 40 AS cap_value FROM nation_caps QUALIFY row_number() OVER (PARTITION BY entity ORDER BY segment) = 1)
SELECT f.entity, count(DISTINCT future_id) AS n_futures, {r("avg(CASE WHEN value < cap_value THEN 1 ELSE 0 END)", "meets_cap_value")}, {r("any_value(cap_value)", "cap_cap_value")}
FROM futures f JOIN one ON f.entity = one.entity WHERE period = 2000 AND cap_value IS NOT NULL GROUP BY f.entity""")
def cap_share_repeated_caps(spark: SparkSession, sf: str) -> DataFrame:
    repeated = nation_caps(spark, sf).select(F.upper("entity").alias("entity"), (F.col("cap_value") * 40).alias("cap_value"), "segment")
    return rounded(probability.cap_share(observed_futures(spark, sf), repeated, 2000, "value", ["cap_value"], keep_caps=True, cap_order=["segment"]))


@query("cap_share_first_row_null", with_sql("futures", "gappy_caps") + f"""
, one AS (SELECT upper(entity) AS entity, cap_value * 40 AS cap_value FROM gappy_caps QUALIFY row_number() OVER (PARTITION BY entity ORDER BY segment) = 1)
SELECT f.entity, count(DISTINCT future_id) AS n_futures, {r("avg(CASE WHEN value < cap_value THEN 1 ELSE 0 END)", "meets_cap_value")}, {r("any_value(cap_value)", "cap_cap_value")}
FROM futures f JOIN one ON f.entity = one.entity WHERE period = 2000 AND cap_value IS NOT NULL GROUP BY f.entity""")
def cap_share_first_row_null(spark: SparkSession, sf: str) -> DataFrame:
    """A missing cap in an entity's first row leaves it out; one in its last row changes nothing."""
    repeated = gappy_caps(spark, sf).select(F.upper("entity").alias("entity"), (F.col("cap_value") * 40).alias("cap_value"), "segment")
    return rounded(probability.cap_share(observed_futures(spark, sf), repeated, 2000, "value", ["cap_value"], keep_caps=True, cap_order=["segment"]))


@query("q1_mean", with_sql("panel", SIM, LOW_SQL) + f"SELECT entity, {r('q1_mean', 'q1_mean')} FROM low")
def q1_mean(spark: SparkSession, sf: str) -> DataFrame:
    target = staged(simulated(spark, sf).where(F.col("period") == END_PERIOD))
    return rounded(probability.q1_mean(target, END_PERIOD, "revenue"))


@query("probability_table", with_sql("panel", "cap_reference", SIM, CAPS_SQL, SHARE_SQL, LOW_SQL) + f"""
SELECT entity, n_futures, {r("meets_unconditional", "meets_unconditional")}, {r("meets_conditional", "meets_conditional")}, {r("base_value", "base_value")},
  {r("unconditional", "unconditional")}, {r("conditional", "conditional")}, {r("q1_mean", "q1_mean")}
FROM shares LEFT JOIN caps USING (entity) LEFT JOIN low USING (entity)""")
def probability_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probability.probability_table(simulated(spark, sf), caps(spark, sf), END_PERIOD, "revenue", CAPS))


@query("probability_headline", with_sql("panel", "cap_reference", SIM, CAPS_SQL, SHARE_SQL) + f"""
SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT CASE WHEN meets_unconditional > 0.5 THEN entity END) AS n_above,
  {r("100.0 * count(DISTINCT CASE WHEN meets_unconditional > 0.5 THEN entity END) / count(DISTINCT entity)", "pct_above")} FROM shares""")
def probability_headline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probability.headline(shares(spark, sf), "meets_unconditional"))


@query("exceedance_curve", with_sql("panel", "cap_reference", SIM, CAPS_SQL, SHARE_SQL) + f"""
SELECT CAST(i AS INTEGER) AS step, {r("i * (1.0::DOUBLE / 199)", "threshold")}, {r("avg(CASE WHEN meets_unconditional >= CASE WHEN i = 199 THEN 1 ELSE i * (1.0::DOUBLE / 199) END THEN 1 ELSE 0 END)", "share")}
FROM generate_series(0, 199) t(i), shares WHERE meets_unconditional IS NOT NULL GROUP BY i""")
def exceedance_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probability.exceedance_curve(shares(spark, sf), "meets_unconditional"))


@query("probability_histogram", with_sql("panel", "cap_reference", SIM, CAPS_SQL, SHARE_SQL) + f"""
, long AS (SELECT 'meets_unconditional' AS variable, meets_unconditional AS value FROM shares UNION ALL SELECT 'meets_conditional', meets_conditional FROM shares),
e AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY variable),
b AS (SELECT variable, lo, hi, CAST(least(floor(coalesce((value - lo) * 40 / nullif(hi - lo, 0), 0)), 39) AS INTEGER) AS bin FROM long JOIN e USING (variable) WHERE value IS NOT NULL)
SELECT variable, bin, {r("lo + (hi - lo) / 40 * bin", "bin_start")}, {r("lo + (hi - lo) / 40 * (bin + 1)", "bin_end")}, count(*) AS count FROM b GROUP BY variable, lo, hi, bin""")
def probability_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histogram(staged(shares(spark, sf)), ["meets_unconditional", "meets_conditional"], 40))


@query("caps_upper_key_join", with_sql("futures", "nation_caps") + """
, wide AS (SELECT entity, future_id, max(CASE WHEN period = 1996 THEN value END) AS "1996", max(CASE WHEN period = 2000 THEN value END) AS "2000" FROM futures GROUP BY entity, future_id),
one AS (SELECT upper(entity) AS entity, cap_value AS cap FROM nation_caps QUALIFY row_number() OVER (PARTITION BY entity ORDER BY segment) = 1)
SELECT wide.entity, future_id, "1996", "2000", CASE WHEN "2000" > "1996" THEN 1 ELSE 0 END AS vulnerability_indicator, cap FROM wide LEFT JOIN one ON wide.entity = one.entity""")
def caps_upper_key_join(spark: SparkSession, sf: str) -> DataFrame:
    labelled = vulnerability.label_futures(observed_futures(spark, sf), "value", 1996, 2000)
    return vulnerability.attach_caps(labelled, nation_caps(spark, sf), "cap_value", order=["segment"])


# ------------------------------------------------------------ on futures that are read, not simulated

def observed_caps(spark: SparkSession, sf: str) -> DataFrame:
    """One row per nation: its lowest and highest cap."""
    return nation_caps(spark, sf).groupBy(F.upper("entity").alias("entity")).agg(
        (F.min("cap_value") * 40).alias("unconditional"), (F.max("cap_value") * 40).alias("conditional")
    )


OBSERVED_SQL = """
caps AS (SELECT upper(entity) AS entity, min(cap_value) * 40 AS unconditional, max(cap_value) * 40 AS conditional FROM nation_caps GROUP BY 1),
ev AS (SELECT f.entity, future_id, value, unconditional, conditional FROM futures f JOIN caps c ON f.entity = c.entity WHERE period = 2000 AND coalesce(unconditional, conditional) IS NOT NULL),
shares AS (SELECT entity, count(DISTINCT future_id) AS n_futures, avg(CASE WHEN value < unconditional THEN 1 WHEN unconditional IS NOT NULL THEN 0 END) AS meets_unconditional,
  avg(CASE WHEN value < conditional THEN 1 WHEN conditional IS NOT NULL THEN 0 END) AS meets_conditional FROM ev GROUP BY entity),
cut AS (SELECT entity, quantile_cont(value, 0.25) AS q FROM futures WHERE period = 2000 GROUP BY entity),
low AS (SELECT f.entity, avg(value) AS q1_mean FROM futures f JOIN cut ON f.entity = cut.entity AND value <= q WHERE period = 2000 GROUP BY f.entity)"""


@query("probability_table_observed", with_sql("futures", "nation_caps", OBSERVED_SQL) + f"""
SELECT entity, n_futures, {r("meets_unconditional", "meets_unconditional")}, {r("meets_conditional", "meets_conditional")}, {r("unconditional", "unconditional")},
  {r("conditional", "conditional")}, {r("q1_mean", "q1_mean")} FROM shares LEFT JOIN caps USING (entity) LEFT JOIN low USING (entity)""")
def probability_table_observed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probability.probability_table(observed_futures(spark, sf), observed_caps(spark, sf), 2000, "value", CAPS))


@query("probability_headline_observed", with_sql("futures", "nation_caps", OBSERVED_SQL) + f"""
SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT CASE WHEN meets_conditional > 0.5 THEN entity END) AS n_above,
  {r("100.0 * count(DISTINCT CASE WHEN meets_conditional > 0.5 THEN entity END) / count(DISTINCT entity)", "pct_above")} FROM shares""")
def probability_headline_observed(spark: SparkSession, sf: str) -> DataFrame:
    table = probability.cap_share(observed_futures(spark, sf), observed_caps(spark, sf), 2000, "value", CAPS)
    return rounded(probability.headline(table, "meets_conditional"))
