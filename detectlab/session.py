"""Session helpers: defaults, table reads, durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "detectlab", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators expect. A cluster's own settings win where it sets them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, slices: int = 1) -> DataFrame:
    """Input of a fan-out over all cores, in ``slices`` tasks a core. Only an input of fewer partitions (small files) is shuffled;
    a large input already has its splits and is left alone."""
    wanted = df.sparkSession.sparkContext.defaultParallelism * slices
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own setting, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that several branches of one job read: later stages start from files, so a lost executor does not
    re-run the plan behind them, and the files carry exact sizes for the join strategy.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
