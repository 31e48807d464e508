"""Staged tables that are removed as soon as the next one stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logvigil import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a query's shuffle files go when it ends

class Scratch:
    """Tables in the shared folder, so that a lost executor costs only its tasks, for as long as they are needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path: dict[int, str] = {}

    def stage(self, df: DataFrame, name: str, even: bool = True) -> DataFrame:
        """Write a frame once and read it back; ``even`` deals the rows out anew, for what is unevenly left of a scan."""
        path = f"{session.shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            (df.hint("rebalance") if even else df).write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        held = self.spark.read.schema(df.schema).parquet(path)
        self.path[id(held)] = path
        self._collect()
        return held

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in filter(None, (self.path.pop(id(t), "") for t in tables)):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)

    def _collect(self) -> None:
        # other actions' shuffle files go when the driver's garbage is collected, which may be long after
        self.spark._jvm.System.gc()
