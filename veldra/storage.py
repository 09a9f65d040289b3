"""Tables written in the shared folder of the cluster, to cut lineage so that lost executors cost one stage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local one is set, on one machine only."""
    sc = spark.sparkContext
    found = sc.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veldra-")
        sc.setCheckpointDir(found)
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for any URI."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


class Scratch:
    """A folder of its own for one run of an operator.

    ``keep(df, name)`` writes a Parquet table and reads it back: it survives lost executors and later steps don't
    recompute it. ``drop(name)`` deletes a table that nothing reads any more. What the returned result still reads
    stays until ``clear(spark)`` is called or the cluster empties the folder.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self._n = spark, f"{shared_root(spark)}/veldra/{tag}-{uuid.uuid4().hex}", 0

    def fresh(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = self.fresh(name)
        df.write.parquet(out)
        kept = self.spark.read.schema(df.schema).parquet(out)
        kept.scratch_path = out
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            if df is not None and getattr(df, "scratch_path", None):
                delete(self.spark, df.scratch_path)
                df.scratch_path = None

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are written: they go when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every table that operators left in the shared folder. Results that still read them become unusable."""
    delete(spark, f"{shared_root(spark)}/veldra")
