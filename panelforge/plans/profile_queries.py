"""Profiling and cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.scalar import clean_number, signed_expm1, signed_log1p, slugify
from panelforge.operators import cleaning, profile
from panelforge.plans.inputs import (
    VARIABLES,
    nation_caps,
    observed_futures,
    supplier_panel,
    table,
    user_days,
    with_sql,
)
from panelforge.plans.registry import query, r, rounded

UNPIVOT = "long AS (SELECT variable, value FROM (SELECT " + ", ".join(VARIABLES) + " FROM panel) UNPIVOT INCLUDE NULLS (value FOR variable IN (" + ", ".join(VARIABLES) + ")))"
DAYS_LONG = "long AS (SELECT variable, value FROM (SELECT amount, n_events FROM user_days) UNPIVOT INCLUDE NULLS (value FOR variable IN (amount, n_events)))"


@query("panel_profile", with_sql("panel", UNPIVOT) + f"""
SELECT variable, {r("avg(CASE WHEN value = 0 THEN 1 ELSE 0 END)", "zero_share")}, {r("var_samp(value)", "variance")},
  count(DISTINCT value) = 2 AS is_binary, bool_and(coalesce(value = 0, false)) AS is_all_zero FROM long GROUP BY variable""")
def panel_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.zeros_and_variance(supplier_panel(spark, sf), VARIABLES))


@query("panel_describe", with_sql("user_days", DAYS_LONG) + f"""
SELECT variable, count(value) AS n, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "std")}, {r("min(value)", "min")}, {r("max(value)", "max")},
  {r("quantile_cont(value, 0.25)", "p25", 4)}, {r("quantile_cont(value, 0.5)", "p50", 4)}, {r("quantile_cont(value, 0.75)", "p75", 4)} FROM long GROUP BY variable""")
def panel_describe(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.describe(user_days(spark, sf), ["amount", "n_events"])
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("p25", "p50", "p75")}))


@query("null_counts", with_sql("user_days", DAYS_LONG) + """
SELECT variable, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, count(DISTINCT value) AS n_distinct FROM long GROUP BY variable""")
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_counts(user_days(spark, sf), ["amount", "n_events"])


@query("category_pct", """
WITH long AS (SELECT 'event_type' AS variable, event_type AS category FROM events
  UNION ALL SELECT 'busy', CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' END FROM events)
SELECT variable, category, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY variable), 2) + 0.0::DOUBLE AS pct
FROM long WHERE category IS NOT NULL GROUP BY variable, category""")
def category_pct(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events", ["event_type", "value"])
    busy = F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "mid")
    return rounded(profile.category_percentages(events.withColumn("busy", busy), ["event_type", "busy"]))


@query("category_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.category_counts(table(spark, sf, "orders", ["o_orderpriority"]), "o_orderpriority")


@query("top_category", """
WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2)
SELECT * FROM c WHERE count = (SELECT max(count) FROM c)""")
def top_category(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("count"))
    return profile.tied_for_most(counts)


@query("skew_profile", with_sql("panel", UNPIVOT) + f"""
, s AS (SELECT variable, CASE WHEN min(value) < max(value) THEN skewness(value) ELSE 0 END AS skewness, min(value) AS min FROM long GROUP BY variable)
SELECT variable, {r("skewness", "skewness")}, {r("min", "min")}, coalesce(abs(skewness) >= 1, false) AS is_skewed FROM s""")
def skew_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.skew_profile(supplier_panel(spark, sf), VARIABLES))


@query("signed_log_features", with_sql("panel") + f"""
SELECT entity, period, {r("sign(net_margin) * ln(1 + abs(net_margin))", "x_log_signed_net_margin")},
  {r("net_margin", "net_margin_back")}, {r("sign(revenue) * ln(1 + abs(revenue))", "x_log_signed_revenue")} FROM panel""")
def signed_log_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(supplier_panel(spark, sf).select(
        "entity", "period", signed_log1p("net_margin").alias("x_log_signed_net_margin"),
        signed_expm1(signed_log1p("net_margin")).alias("net_margin_back"), signed_log1p("revenue").alias("x_log_signed_revenue"),
    ))


@query("log_transform_skewed", with_sql("user_days") + f"""
, s AS (SELECT (skewness(amount) > 1 OR skewness(amount) < -1) AND min(amount) >= 0 AS a, (skewness(n_events) > 1 OR skewness(n_events) < -1) AND min(n_events) >= 0 AS n FROM user_days)
SELECT entity, period, {r("CASE WHEN a THEN ln(1 + amount) ELSE amount END", "amount_used")}, {r("CASE WHEN n THEN ln(1 + n_events) ELSE n_events END", "n_events_used")} FROM user_days, s""")
def log_transform_skewed(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.log_transform_skewed(user_days(spark, sf), ["amount", "n_events"])
    used = [F.col(c if c in out.columns else f"log_{c}").alias(f"{c}_used") for c in ("amount", "n_events")]
    return rounded(out.select("entity", "period", *used))


@query("zscore_outlier_pct", with_sql("panel", UNPIVOT) + f"""
, z AS (SELECT long.variable, coalesce(abs((value - m) / nullif(s, 0)) > 2, false) AS o FROM long
  JOIN (SELECT variable, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY variable) t USING (variable))
SELECT variable, {r("100 * avg(CASE WHEN o THEN 1 ELSE 0 END)", "outlier_pct")} FROM z GROUP BY variable HAVING bool_or(o)""")
def zscore_outlier_pct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.outlier_share(supplier_panel(spark, sf), VARIABLES, 2.0))


@query("five_number_by_class", f"""
WITH q AS (SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM events GROUP BY 1)
SELECT event_type, n, {r("any_value(q.min)", "min")}, {r("any_value(p25)", "p25", 4)}, {r("any_value(p50)", "p50", 4)}, {r("any_value(p75)", "p75", 4)}, {r("any_value(q.max)", "max")},
  min(CASE WHEN value >= p25 - 1.5 * (p75 - p25) THEN value END) AS whisker_low, max(CASE WHEN value <= p75 + 1.5 * (p75 - p25) THEN value END) AS whisker_high,
  sum(CASE WHEN value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25) THEN 1 ELSE 0 END)::BIGINT AS n_outside
FROM events JOIN q USING (event_type) GROUP BY event_type, n""")
def five_number_by_class(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.five_numbers(table(spark, sf, "events", ["event_type", "value"]), "value", "event_type")
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("p25", "p50", "p75")}))


CORR = "CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"


@query("corr_by_entity", with_sql("user_days") + f"""
, d AS (SELECT entity, amount, n_events FROM user_days WHERE amount IS NOT NULL),
c AS (SELECT entity, covar_pop(amount, n_events) / nullif(stddev_pop(amount) * stddev_pop(n_events), 0) AS correlation FROM d GROUP BY entity HAVING min(amount) < max(amount) AND min(n_events) < max(n_events))
SELECT entity, {r("correlation", "correlation")} FROM (SELECT DISTINCT 'U' || (user_id + 1) AS entity FROM events) LEFT JOIN c USING (entity)""")
def corr_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "events", ["user_id"]).select(F.concat(F.lit("U"), F.col("user_id") + 1).alias("entity"))
    return rounded(profile.correlation_by_entity(user_days(spark, sf), "amount", "n_events", wanted=wanted))


@query("corr_matrix", with_sql("panel") + "SELECT row_var, col_var, round(correlation, 6) + 0.0::DOUBLE AS correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS row_var, '{b}' AS col_var, corr({a}, {b}) AS correlation FROM panel" for a in VARIABLES for b in VARIABLES) + ")")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.correlation_matrix(supplier_panel(spark, sf), VARIABLES))


@query("within_group_std", with_sql("panel") + f"""
, s AS (SELECT entity, stddev_samp(revenue) AS revenue, stddev_samp(avg_discount) AS avg_discount FROM panel GROUP BY entity)
SELECT 'revenue' AS variable, {r("quantile_cont(revenue, 0.5)", "median_within_std")} FROM s UNION ALL
SELECT 'avg_discount', {r("quantile_cont(avg_discount, 0.5)", "median_within_std")} FROM s""")
def within_group_std(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.within_group_std(supplier_panel(spark, sf), ["revenue", "avg_discount"]))


@query("histogram", with_sql("panel", UNPIVOT) + f"""
, e AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY variable),
b AS (SELECT variable, lo, hi, CAST(least(floor(coalesce((value - lo) * 20 / nullif(hi - lo, 0), 0)), 19) AS INTEGER) AS bin FROM long JOIN e USING (variable))
SELECT variable, bin, {r("lo + (hi - lo) / 20 * bin", "bin_start")}, {r("lo + (hi - lo) / 20 * (bin + 1)", "bin_end")}, count(*) AS count FROM b GROUP BY variable, lo, hi, bin""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.histogram(supplier_panel(spark, sf), VARIABLES, 20))


WIDE = [*VARIABLES, "lines_and_returns", "revenue_twice"]
V = len(WIDE)
# Elimination in SQL: a copy of the correlation matrix per column, from which the other columns are swept one after the other; what is
# left of the column's own diagonal is the share that they leave unexplained. The worst column goes, and all copies start anew.
VIF_SQL = f"""
wide AS (SELECT *, n_lines + return_share AS lines_and_returns, revenue * 2 + n_lines AS revenue_twice FROM panel),
c0 AS (SELECT [{", ".join(f"corr({a}, {b})" for _ in WIDE for a in WIDE for b in WIDE)}]::DOUBLE[] AS c FROM wide),
sweeps(p, step, kept, a, factors, dropped_at) AS (
  SELECT 1, 0, list_transform(range({V}), lambda x: true), c, NULL::DOUBLE[], list_transform(range({V}), lambda x: NULL::INTEGER) FROM c0
  UNION ALL
  SELECT CASE WHEN p <= {V} THEN p + 1 ELSE 1 END, CASE WHEN p <= {V} THEN step ELSE step + 1 END,
    CASE WHEN p <= {V} THEN kept ELSE list_transform(kept, lambda x, i: x AND i <> worst) END,
    CASE WHEN p > {V} THEN c0.c WHEN NOT kept[p] THEN a ELSE list_transform(a, lambda x, i: CASE
      WHEN (i - 1) // {V * V} = p - 1 OR a[((i - 1) // {V * V}) * {V * V} + (p - 1) * {V + 1} + 1] <= 1e-10 THEN x
      ELSE x - a[((i - 1) // {V}) * {V} + p] * a[((i - 1) // {V * V}) * {V * V} + (p - 1) * {V} + (i - 1) % {V} + 1] / a[((i - 1) // {V * V}) * {V * V} + (p - 1) * {V + 1} + 1] END) END,
    CASE WHEN p <= {V} THEN factors ELSE list_transform(factors, lambda x, i: CASE WHEN kept[i] THEN now[i] ELSE x END) END,
    CASE WHEN p <= {V} THEN dropped_at ELSE list_transform(dropped_at, lambda x, i: CASE WHEN i = worst THEN step + 1 ELSE x END) END
  FROM (SELECT *, list_position(list_transform(now, lambda x, i: CASE WHEN kept[i] THEN x ELSE 0 END), list_max(list_transform(now, lambda x, i: CASE WHEN kept[i] THEN x ELSE 0 END))) AS worst
    FROM (SELECT * REPLACE (coalesce(factors, list_transform(range({V}), lambda x: 0::DOUBLE)) AS factors),
      list_transform(range({V}), lambda j: CASE WHEN a[j * {V * V + V + 1} + 1] > 1e-10 THEN 1 / a[j * {V * V + V + 1} + 1] ELSE 'inf'::DOUBLE END) AS now FROM sweeps)), c0
  WHERE p <= {V} OR (len(list_filter(kept, lambda x: x)) > 1 AND now[worst] > 5)),
ends AS (SELECT kept, factors, dropped_at, list_transform(range({V}), lambda j: CASE WHEN kept[j + 1] THEN CASE WHEN a[j * {V * V + V + 1} + 1] > 1e-10 THEN 1 / a[j * {V * V + V + 1} + 1] ELSE 'inf'::DOUBLE END ELSE factors[j + 1] END) AS vif
  FROM sweeps WHERE p = {V} + 1 ORDER BY step DESC LIMIT 1)"""


@query("vif_elimination", with_sql("panel", VIF_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT ({WIDE!r})[j] AS variable, dropped_at[j] AS dropped_at, CASE WHEN isinf(vif[j]) THEN vif[j] ELSE round(vif[j], 6) END AS vif FROM ends, range(1, {V + 1}) t(j)""")
def vif_elimination(spark: SparkSession, sf: str) -> DataFrame:
    panel = supplier_panel(spark, sf)
    extended = panel.withColumns({"lines_and_returns": F.col("n_lines") + F.col("return_share"), "revenue_twice": F.col("revenue") * 2 + F.col("n_lines")})
    found = profile.vif_elimination(extended, WIDE)
    return found.withColumn("vif", F.when(F.col("vif") == float("inf"), F.col("vif")).otherwise(F.round("vif", 6)))


@query("pruned_columns", with_sql("panel") + f"""
, w AS (SELECT entity, period, revenue, n_lines, return_share, 0.0::DOUBLE AS zeros, CASE WHEN revenue < -1 THEN 1.0 END AS empty FROM panel)
SELECT entity, period, {r("revenue", "revenue")} FROM w""")
def pruned_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = supplier_panel(spark, sf).select(
        "entity", "period", "revenue", "n_lines", "return_share", F.lit(0.0).alias("zeros"), F.when(F.col("revenue") < -1, 1.0).alias("empty")
    )
    fewer = cleaning.drop_groups(wide, {"leakage": ["n_lines", "return_share", "not_there"], "other": ["revenue"]}, ["leakage"])
    kept = cleaning.drop_all_zero(fewer, ["revenue", "zeros"])
    return rounded(cleaning.drop_all_null(kept, ["revenue", "empty"]))


@query("clean_numbers", """
SELECT event_id, TRY_CAST(txt AS DOUBLE) AS number FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS txt FROM events)
WHERE TRY_CAST(txt AS DOUBLE) IS NOT NULL""")
def clean_numbers(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events", ["event_id", "event_type", "value"])
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
    out = events.select("event_id", clean_number(text, finite=True).alias("number"))
    return cleaning.drop_missing(out, ["number"])


@query("dedupe_keep_first", with_sql("nation_caps") + """
SELECT upper(entity) AS entity, cap_value, segment FROM nation_caps QUALIFY row_number() OVER (PARTITION BY upper(entity) ORDER BY segment) = 1""")
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.reference_dimension(nation_caps(spark, sf), "entity", ["cap_value", "segment"], ["segment"])


@query("entity_selection", with_sql("futures") + """
SELECT entity, future_id, period, value FROM futures WHERE upper(entity) IN ('NATION_3', 'NATION_7', 'NATION_11')""")
def entity_selection(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.select_entities(observed_futures(spark, sf), ["nation_3", " Nation_7", "NATION_11"]).select("entity", "future_id", "period", "value")


@query("missing_reference_keys", """
SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def missing_reference_keys(spark: SparkSession, sf: str) -> DataFrame:
    reference = table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("custkey"))
    urgent = table(spark, sf, "orders", ["o_custkey", "o_orderpriority"]).where("o_orderpriority = '1-URGENT'")
    return cleaning.missing_keys(reference, urgent.select(F.col("o_custkey").alias("custkey")), "custkey")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS priority_{slugify(p)}" for p in PRIORITIES[1:]) + " FROM orders")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
    out = cleaning.one_hot(orders.withColumnRenamed("o_orderpriority", "priority"), ["priority"], drop_first=True)
    return out.toDF(*[c if c == "o_orderkey" else f"priority_{slugify(c.removeprefix('priority_'))}" for c in out.columns])
