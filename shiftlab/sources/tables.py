"""Access to the parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from shiftlab.session import scratch_path


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read ``<data_dir>/<name>.parquet``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back: steps
    that read it many times neither recompute it nor depend on the executors that made it.
    ``partition`` names a column whose values get folders of their own."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """A file system for use inside tasks, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and "://" not in path else path)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system Spark can read is a folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over the cluster when the scan has fewer splits than cores.

    Heavy per-row work (tokenising whole texts) should use every core. A
    large table already arrives in many splits and is returned unchanged (no
    shuffle); only an under-split input (e.g. one big row group) is spread.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
