"""Tables that end a plan's lineage, in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application under spark.checkpoint.dir; where that is unset on one machine, under /tmp.

    A cluster must have the setting: executors that wrote to their own disks would lose each other's rows.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written once and read again: iterations neither grow their plans nor lose work with an executor."""
    return Steps(df.sparkSession).write(df)[0]


class Steps:
    """The tables of one iteration. Those that a later step replaces can be dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
        """(df written and read again, n (its rows) and the values, aggregated while it is written: no job of their own)."""
        told = Observation()
        out = shared_folder(self.spark, "step")
        df.observe(told, F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in values.items()]).write.parquet(out)
        found = self.spark.read.schema(df.schema).parquet(out)
        self._paths[id(found)] = (found, out)
        return found, told.get

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path is not None:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
