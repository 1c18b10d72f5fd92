"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the setting is absent, a session on this machine alone (tests, a laptop) gets a folder of its own; on a cluster
    that would be another folder on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="acreline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below shared_dir that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of new_dir in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    return written_at(df, new_dir(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Asks for a garbage collection, upon which Spark deletes the shuffle files that no DataFrame needs any more.

    Without it they stay until the driver's memory happens to be collected; a job that shuffles its whole input more than
    once would have all of them on disk at a time.
    """
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of one job, which clear() deletes when the last of them has been read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_dir(spark, name), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        return written_at(df, f"{self.path}/{self.tables:03d}-{name}")

    def clear(self) -> None:
        delete(self.spark, self.path)
