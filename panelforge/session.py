"""Session defaults and staging of intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` (or set on the context) is used as it is. Only a local
    session without one gets a temporary folder; a cluster session without a shared folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a shared folder before running this operator")
    return context.getCheckpointDir()


def staged(df: DataFrame, path: str | None = None, name: str = "staged") -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and go on from the written files.

    Unlike a checkpoint the table keeps column pruning and statistics, and the lineage still ends at files that every
    executor can read. Without a path a new folder below the shared checkpoint folder is taken. The files
    belong to the caller, who clears them by path or, after the run, with :func:`clear_staged`.
    """
    target = path or f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def clear_staged(spark: SparkSession, path: str | None = None) -> None:
    """Delete the staged tables below ``path``, or all below this session's checkpoint folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or checkpoint_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
