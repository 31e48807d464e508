"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive log times are read as UTC, so the session has to run in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return configured.rstrip("/")


def ensure_shared_dir(spark: SparkSession) -> None:
    """For entry points: where no shared folder is set, use one in the warehouse, which is shared by its nature."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Used where several consumers would otherwise repeat an expensive scan (the signature
    matching). The copy survives the loss of executors and carries its true size, so
    the optimizer picks broadcast or shuffle joins on it from facts. What is left of a big scan
    is small and unevenly spread; rebalancing writes it in files of a sensible size instead
    of one per scan task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_entries(entries: DataFrame) -> DataFrame:
    """Write parsed entries once, a folder per log type, and read them back.

    For entries parsed from text: the detectors read them several times, and what looks at web
    logs only then reads only those folders. Tasks write where they are; nothing is shuffled.
    """
    spark = entries.sparkSession
    path = f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}"
    entries.write.partitionBy("log_type").parquet(path)
    return spark.read.schema(entries.schema).parquet(path).select(*entries.columns)
