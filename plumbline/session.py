"""Session construction and the shared folder used to cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that
names none gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import plumbline

# Pandas functions travel to the executors by value, so the cluster needs no installed package.
cloudpickle.register_pickle_by_value(plumbline)


def build_session(
    app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings every job here relies on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for stream state and intermediate tables."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and returns the table.

    Later steps all see the same rows, read only the columns they need and know the table's size; a
    lost executor costs a re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by the hash of ``keys`` over every shuffle partition.

    The number is given, so adaptive execution does not merge partitions whose rows are yet to grow. A grouping whose keys
    include ``keys`` needs no other shuffle, and no task keeps groups of rows that it only passes on.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
