"""Round trips through files: what is written must come back unchanged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans.inputs import gappy_caps, observed_futures, supplier_panel, with_sql
from panelforge.plans.registry import query
from panelforge.session import checkpoint_folder
from panelforge.sources import io

PANEL_SCHEMA = "entity string, period int, revenue double, net_margin double"


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


@query("csv_round_trip", with_sql("panel") + "SELECT entity, period, revenue, net_margin FROM panel")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    io.write_csv(supplier_panel(spark, sf).select("entity", "period", "revenue", "net_margin"), path)
    return io.read_csv(spark, path, PANEL_SCHEMA)


@query("partitioned_ensemble_scan", with_sql("futures") + "SELECT entity, future_id, period, value FROM futures WHERE entity IN ('NATION_1', 'NATION_2')")
def partitioned_ensemble_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Store the ensemble by entity, then read two entities: only their folders are scanned."""
    base = scratch(spark)
    io.save_run_table(observed_futures(spark, sf).select("entity", "future_id", "period", "value"), base, "ensemble", 1, ["entity"])
    return io.load_run_tables(spark, base, 1, ["ensemble"], ["NATION_1", "NATION_2"])["ensemble"]


@query("bundle_round_trip", with_sql("panel", "futures") + """
SELECT 'history' AS name, count(*) AS n_rows, CAST(sum(revenue) AS DOUBLE) AS total FROM panel UNION ALL SELECT 'futures', count(*), CAST(sum(value) AS DOUBLE) FROM futures""")
def bundle_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark)
    io.save_bundle({"history": supplier_panel(spark, sf), "discovery": {"all": {"futures": observed_futures(spark, sf)}}}, base)
    tables = io.load_bundle(spark, base)
    history, futures = tables["history"], tables["discovery"]["all"]["futures"]
    count = F.count(F.lit(1)).alias("n_rows")
    return history.agg(F.lit("history").alias("name"), count, F.sum("revenue").alias("total")).unionByName(
        futures.agg(F.lit("futures").alias("name"), count, F.sum("value").alias("total"))
    )


@query("reference_table", with_sql("gappy_caps") + "SELECT upper(entity) AS entity, cap_value AS unconditional FROM gappy_caps QUALIFY row_number() OVER (PARTITION BY entity ORDER BY segment) = 1")
def reference_table(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each key in the file counts, with or without a value."""
    path = scratch(spark)
    io.write_csv(gappy_caps(spark, sf).coalesce(1).sortWithinPartitions("segment", "entity"), path)
    return io.read_reference(spark, path, "entity", {"cap_value": "unconditional"}, "entity string, segment string, cap_value double")
