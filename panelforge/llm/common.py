"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.session import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new folder below the shared checkpoint folder and read it again.

    The lineage ends at files that every executor can read, so a lost executor costs no recomputation
    before this point. With ``by`` a folder is written for each value of that column. The files belong to the run; whoever owns the checkpoint folder clears it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def small_side(df: DataFrame, max_rows: int, name: str) -> DataFrame:
    """Stage ``df`` and mark it for broadcasting only if it holds at most ``max_rows`` narrow rows.

    Larger frames come back unmarked, so that the join shuffles and adaptive execution splits hot keys.
    """
    out = staged(df, name)
    return F.broadcast(out) if out.count() <= max_rows else out


def of_worker(shared: Broadcast, build: Callable[[dict], Any]) -> Any:
    """The object that ``build`` makes of a broadcast dict, made once in each Python worker.

    Broadcasts carry plain data only, since executors need not have this package; the class comes with the function.
    """
    held = shared.value
    if "built" not in held:
        held["built"] = build(held)
    return held["built"]
