"""Tables in the folder that driver and executors share, which cut long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, one is made, but only if driver and executors are one process (tests)."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


class Tables:
    """The tables of one run, in a folder of their own. keep() computes a plan once, writes it and reads it back: what follows plans from a scan."""

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, name: str = "table", *parts: str) -> DataFrame:
        path = f"{self.folder}/{self.made}-{name}"
        self.made += 1
        df.write.partitionBy(*parts).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Deletes the folder; DataFrames that read it are of no use any more."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files have fewer splits than that: one row group is one task, however dear what follows is. Large tables have more splits and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
