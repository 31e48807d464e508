"""Scans along the history of a key, when a few keys may hold most of the rows.

Keys of up to ``RUN_ROWS`` rows are scanned by one task each. The rows of longer keys are sorted over all partitions by key and
order, whatever their times are, so that every partition holds one run of consecutive rows. A run is scanned by itself; what the runs
before it leave behind (counts, a last place, countries seen) is one summary row per run, summed up along the runs and joined back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.session import shared_dir, stage

RUN_ROWS = 1_000_000  # a key with more rows is cut into runs; so there are no more such keys than one in a million rows


def long_keys(rows: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys with more than ``RUN_ROWS`` rows, or None. Rows with a null in the key belong to no history."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > RUN_ROWS)
    held = stage(counts.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).select(*key), "long-keys")
    return None if held.isEmpty() else held


def in_runs(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``_run``: the rows of a key are consecutive in ``order`` within a run, and its runs rise.

    The runs are written once. Their borders come from a sample of the rows, so they must not be drawn a second time.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(parts, *[F.col(f"`{c}`") for c in (*key, *order)]).withColumn("_run", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def scan(
    rows: DataFrame, key: list[str], order: list[str], name: str,
    whole: Callable[[DataFrame, str], DataFrame], pieces: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """``whole(rows, partition)`` for the keys one task can scan, ``pieces(runs, partition)`` for the runs of the long ones.

    ``partition`` is the text for PARTITION BY: the key, or the key and the run. Both return the same columns.
    """
    columns = ", ".join(f"`{k}`" for k in key)
    long = long_keys(rows, key)
    if long is None:
        return whole(rows, columns)
    short = whole(rows.join(F.broadcast(long), key, "left_anti"), columns)
    runs = in_runs(rows.join(F.broadcast(long), key, "left_semi"), key, order, name)
    return short.unionByName(pieces(runs, f"{columns}, _run"))


def with_carries(runs: DataFrame, key: list[str], carries: DataFrame) -> DataFrame:
    """Join what the runs before leave behind. There is a row per key and run: no more than partitions and long keys together."""
    return runs.join(F.broadcast(carries), [*key, "_run"])
