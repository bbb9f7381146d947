"""Tables in and out: panels, ensembles, reference tables, table bundles and fitted pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.cleaning import require_columns
from panelforge.operators.grouped import keep_first

FORMATS = ("parquet", "csv")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL; done once on reading."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header row and an explicit schema; inference would read the files twice."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Snappy parquet. With ``partition_by`` rows are first gathered per partition value, spread over
    several tasks when a value is large, so that a value neither makes many tiny files nor one huge one.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *partition_by)
    out = writer.write.mode(mode).option("compression", "snappy")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_reference(spark: SparkSession, path: str, key: str, columns: Mapping[str, str], schema: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Caps or income-group table from CSV or parquet: ``key`` upper-cased, one row per key, no NULL keys.

    ``columns`` maps source columns to output names. Of several rows of a key the first in the file counts, NULLs and all, or the
    first by the columns in ``order``.
    """
    df = read_csv(spark, path, schema) if schema else read_parquet(spark, path)
    require_columns(df, [key, *columns])
    named = [F.upper(F.trim(F.col(key).cast("string"))).alias(key), *[F.col(c).alias(n) for c, n in columns.items()]]
    position = ["_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()]
    places = [F.col(o).alias(f"_order_{i}") if isinstance(o, str) else o.alias(f"_order_{i}") for i, o in enumerate(order or position)]
    out = df.select(*named, *places).where(F.col(key).isNotNull())
    return keep_first(out, [key], [f"_order_{i}" for i in range(len(places))]).select(key, *columns.values())


def _leaves(tables: Mapping, prefix: str = "") -> list[tuple[str, object]]:
    """(relative path, item) of every leaf of a nested mapping."""
    pairs = ((f"{prefix}{name}", item) for name, item in tables.items())
    return [leaf for path, item in pairs for leaf in (_leaves(item, f"{path}/") if isinstance(item, Mapping) else [(path, item)])]


def save_bundle(tables: Mapping, base: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a nested mapping of tables as a folder tree, one table per leaf. Nothing is written unless all of it can be."""
    if fmt not in FORMATS:
        raise ValueError(f"tables are saved as {' or '.join(FORMATS)}, not as {fmt!r}")
    leaves = _leaves(tables)
    odd = [path for path, item in leaves if not isinstance(item, DataFrame)]
    if odd:
        raise TypeError(f"only tables can be saved; these are none: {odd}")
    for path, item in leaves:
        write = write_parquet if fmt == "parquet" else write_csv
        write(item, f"{base}/{path}.{fmt}", mode=mode)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"there is no folder {path}")
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_bundle(spark: SparkSession, base: str, schemas: Mapping[str, str] | None = None) -> dict:
    """Read a folder tree written by :func:`save_bundle`.

    CSV tables take their schema from ``schemas`` (by table name); without one, columns stay strings.
    """
    out: dict = {}
    for name in _children(spark, base):
        path = f"{base}/{name}"
        if name.endswith(".parquet"):
            out[name.removesuffix(".parquet")] = read_parquet(spark, path)
        elif name.endswith(".csv"):
            table = name.removesuffix(".csv")
            known = (schemas or {}).get(table)
            out[table] = read_csv(spark, path, known) if known else spark.read.option("header", True).csv(path)
        else:
            out[name] = load_bundle(spark, path, schemas)
    return out


def run_path(base: str, table: str, run_id: str | int) -> str:
    return f"{base}/{table}/run_id={run_id}"


def save_run_table(df: DataFrame, base: str, table: str, run_id: str | int, partition_by: Sequence[str] = ()) -> None:
    write_parquet(df, run_path(base, table, run_id), partition_by)


def load_run_tables(
    spark: SparkSession, base: str, run_id: str | int, tables: Sequence[str], entities: Sequence[str] | None = None,
    cache: str | None = None, refresh: bool = False, entity: str = "entity",
) -> dict:
    """All tables of one run, failing on a missing one.

    With ``cache`` the tables come from a copy kept there per run, which ``refresh`` (re)writes first. The copy holds whole tables, so
    any selection can be read from it; a table that it lacks is an error, as in the run itself. Only the run's
    folder is listed, and an entity selection is pushed into the scan.
    """
    copy = f"{cache}/run_id={run_id}" if cache else None
    if copy and not refresh:
        kept = load_bundle(spark, copy) if exists(spark, copy) else {}
    else:
        kept = {t: read_parquet(spark, run_path(base, t, run_id)) for t in tables if exists(spark, run_path(base, t, run_id))}
    missing = [t for t in tables if t not in kept]
    if missing:
        raise FileNotFoundError(f"{'the copy of ' if copy and not refresh else ''}run {run_id!r} lacks {missing}")
    out = {t: kept[t] for t in tables}
    if copy and refresh:
        save_bundle(out, copy)
    if entities is not None:
        out = {t: df.where(F.col(entity).isin(*entities)) if entity in df.columns else df for t, df in out.items()}
    return out


def save_model(model: PipelineModel, path: str, rewrite: bool = False) -> bool:
    """Save a fitted pipeline; an existing one is kept unless ``rewrite``. Returns whether it was written."""
    from pyspark.sql import SparkSession

    if exists(SparkSession.active(), path) and not rewrite:
        return False
    (model.write().overwrite() if rewrite else model.write()).save(path)
    return True


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
