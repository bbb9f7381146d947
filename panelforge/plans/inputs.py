"""Panels, ensembles and reference tables derived from the supplied tables.

Measures are whole numbers or one exact division, so every engine gets the same values.
Each frame has its SQL twin in ``SQL`` for the oracle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.ensemble import EnsembleConfig
from panelforge.operators.rules import Rulebook
from panelforge.sources.io import read_parquet

VARIABLES = ["revenue", "n_lines", "avg_discount", "return_share", "has_bulk", "cum_lines", "net_margin"]
BASE_PERIOD = 24
END_PERIOD = 35
SCENARIOS = 12
RULES = Rulebook.from_spec({
    "default_category": "unconstrained",
    "categories": {"binary": ["has_bulk"], "count": ["n_lines"], "cumulative_count": ["cum_lines"], "non_negative": ["revenue"]},
    "prefix_rules": [{"prefix": "avg_", "category": "bounded_0_1"}, {"prefix": "log_", "category": "log_unbounded"}],
    "overrides": {"return_share": "bounded_0_1", "has_urgent": "binary", "n_orders": "count", "cum_orders": "cumulative_count", "any_finished": "cumulative_binary", "max_order": "non_negative"},
})
DRIFT = EnsembleConfig(end_period=END_PERIOD, n_scenarios=SCENARIOS)
CONSTRAINED = replace(DRIFT, rules=RULES)


def table(spark: SparkSession, sf: str, name: str, columns: list[str]) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet", columns)


def cents(c: str):
    return F.rint(F.col(c) * 100).cast("bigint")


def supplier_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier x quarter of shipping; one aggregate over ``lineitem``."""
    lines = table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag"])
    period = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    n = F.count(F.lit(1))
    panel = lines.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("entity"), period.alias("period")).agg(
        F.floor(F.sum(cents("l_extendedprice")) / 100000).cast("double").alias("revenue"),
        n.cast("double").alias("n_lines"),
        (F.sum(cents("l_discount")).cast("double") / (n * 100.0)).alias("avg_discount"),
        (F.count_if(F.col("l_returnflag") == "R").cast("double") / n).alias("return_share"),
        F.max(F.when(F.col("l_quantity") >= 50, 1.0).otherwise(0.0)).alias("has_bulk"),
        F.floor(F.sum(cents("l_extendedprice") * (cents("l_discount") - cents("l_tax"))) / 10000000).cast("double").alias("net_margin"),
    )
    so_far = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn("cum_lines", F.sum("n_lines").over(so_far)).select("entity", "period", *VARIABLES)


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """User x day of ``events``: an irregular panel with missing days and missing amounts."""
    events = table(spark, sf, "events", ["ts", "user_id", "event_type", "value"])
    amount = F.sum(F.when(F.col("event_type") != "error", cents("value"))).cast("double") / 100.0
    return events.groupBy(F.concat(F.lit("U"), "user_id").alias("entity"), F.dayofmonth("ts").alias("period")).agg(
        amount.alias("amount"), F.count(F.lit(1)).cast("double").alias("n_events")
    )


def observed_futures(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as alternative futures of their nation, by order year."""
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    customer = table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    nation = table(spark, sf, "nation", ["n_nationkey", "n_name"])
    yearly = orders.groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(
        F.floor(F.sum(cents("o_totalprice")) / 100000).cast("double").alias("value"),
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("has_urgent"),
        F.max(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("finished"),
        F.floor(F.max(cents("o_totalprice")) / 100000).cast("double").alias("max_order"),
    )
    named = yearly.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    future = F.concat_ws("_", F.lit("id"), "n_name", "o_custkey")
    so_far = Window.partitionBy("entity", "future_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return named.select(
        F.col("n_name").alias("entity"), future.alias("future_id"), "period", "value", "n_orders", "has_urgent", "max_order", "finished"
    ).withColumns({"cum_orders": F.sum("n_orders").over(so_far), "any_finished": F.max("finished").over(so_far)}).drop("finished")


def cap_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Relative caps per supplier, some missing."""
    supplier = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    k = F.col("s_nationkey")
    return supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("entity"),
        F.when(k % 5 != 0, (k - 12).cast("double") / 100.0).alias("unconditional_rel"),
        F.when(k % 5 != 1, (k - 14).cast("double") / 100.0).alias("conditional_rel"),
    )


def nation_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Caps per nation with repeated keys and a missing one, from the customers' balances."""
    customer = table(spark, sf, "customer", ["c_nationkey", "c_mktsegment", "c_acctbal"])
    nation = table(spark, sf, "nation", ["n_nationkey", "n_name"])
    per = customer.groupBy("c_nationkey", "c_mktsegment").agg((F.sum(cents("c_acctbal")).cast("double") / (F.count(F.lit(1)) * 1000.0)).alias("b"))
    cap = F.when((F.col("c_nationkey") % 7 != 3), F.floor(F.col("b")).cast("double"))
    return per.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lower("n_name").alias("entity"), F.col("c_mktsegment").alias("segment"), cap.alias("cap_value")
    )


def gappy_caps(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`nation_caps`, but every second nation lacks the cap of its first segment and the others that of their last."""
    caps = nation_caps(spark, sf)
    number = F.substring_index("entity", "_", -1).cast("int")
    gap = F.when(number % 2 == 0, F.lit("AUTOMOBILE")).otherwise(F.lit("MACHINERY"))
    return caps.withColumn("cap_value", F.when(F.col("segment") != gap, F.col("cap_value")))


def income_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Region as the income group of each nation; one region stays unclassified."""
    nation = table(spark, sf, "nation", ["n_name", "n_regionkey"])
    region = table(spark, sf, "region", ["r_regionkey", "r_name"])
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey <> 4").select(
        F.col("n_name").alias("entity"), F.col("r_name").alias("income_group")
    )


SQL = {
    "panel": """
panel0 AS (SELECT 'S' || l_suppkey AS entity,
    CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS period,
    CAST(floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100000) AS DOUBLE) AS revenue,
    CAST(count(*) AS DOUBLE) AS n_lines,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS avg_discount,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS return_share,
    CAST(max(CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END) AS DOUBLE) AS has_bulk,
    CAST(floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (CAST(round(l_discount * 100) AS BIGINT) - CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / 10000000) AS DOUBLE) AS net_margin
  FROM lineitem GROUP BY 1, 2),
panel AS (SELECT *, sum(n_lines) OVER (PARTITION BY entity ORDER BY period) AS cum_lines FROM panel0)""",
    "user_days": """
user_days AS (SELECT 'U' || user_id AS entity, CAST(day(ts) AS INTEGER) AS period,
    CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) / 100.0::DOUBLE AS amount,
    CAST(count(*) AS DOUBLE) AS n_events FROM events GROUP BY 1, 2)""",
    "futures": """
futures0 AS (SELECT n_name AS entity, 'id_' || n_name || '_' || o_custkey AS future_id, CAST(year(o_orderdate) AS INTEGER) AS period,
    CAST(floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000) AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS n_orders,
    CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS has_urgent,
    CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS finished,
    CAST(floor(CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000) AS DOUBLE) AS max_order
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
futures AS (SELECT * EXCLUDE (finished), sum(n_orders) OVER w AS cum_orders, max(finished) OVER w AS any_finished
  FROM futures0 WINDOW w AS (PARTITION BY entity, future_id ORDER BY period))""",
    "cap_reference": """
cap_reference AS (SELECT 'S' || s_suppkey AS entity,
    CASE WHEN s_nationkey % 5 <> 0 THEN CAST(s_nationkey - 12 AS DOUBLE) / 100.0::DOUBLE END AS unconditional_rel,
    CASE WHEN s_nationkey % 5 <> 1 THEN CAST(s_nationkey - 14 AS DOUBLE) / 100.0::DOUBLE END AS conditional_rel FROM supplier)""",
    "nation_caps": """
nation_caps AS (SELECT lower(n_name) AS entity, segment, CASE WHEN n_nationkey % 7 <> 3 THEN floor(b) END AS cap_value FROM (
    SELECT c_nationkey, c_mktsegment AS segment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1000.0::DOUBLE) AS b
    FROM customer GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey)""",
    "gappy_caps": """
gappy_caps AS (SELECT lower(n_name) AS entity, segment, CASE WHEN n_nationkey % 7 <> 3 AND segment <> CASE WHEN n_nationkey % 2 = 0 THEN 'AUTOMOBILE' ELSE 'MACHINERY' END THEN floor(b) END AS cap_value FROM (
    SELECT c_nationkey, c_mktsegment AS segment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1000.0::DOUBLE) AS b
    FROM customer GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey)""",
    "income": """
income AS (SELECT n_name AS entity, r_name AS income_group FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4)""",
}


def with_sql(*parts: str) -> str:
    """``WITH`` clause from names of ``SQL`` and further CTE texts."""
    return "WITH " + ",\n".join(SQL.get(p, p).strip() for p in parts) + "\n"
