"""J4 against storage: which artifacts lie under a folder, listed by Spark in tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_THRESHOLD = "spark.sql.sources.parallelPartitionDiscovery.threshold"


def stored_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(path, length)`` of all files below ``root`` whose names fit the glob ``pattern``.

    Folders are listed by tasks through the Hadoop file systems, whatever their number (the
    driver lists ``root`` itself only), and no file is opened: of a binary file only its
    path and length are read. Raises if ``root`` does not exist.
    """
    before = spark.conf.get(_THRESHOLD, None)
    spark.conf.set(_THRESHOLD, "0")
    try:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        return reader.load(root).select("path", "length")       # lists here, while the setting holds
    finally:
        if before is None:
            spark.conf.unset(_THRESHOLD)
        else:
            spark.conf.set(_THRESHOLD, before)


def stored_artifacts(spark: SparkSession, root: str, layout: str, keys: dict[str, str],
                     pattern: str | None = None) -> DataFrame:
    """The artifacts found below ``root``, a row per distinct key.

    ``layout`` is a regular expression over a file's path with a group per entry of ``keys``
    (column name -> type), in order; files that do not fit it are no artifacts, and empty
    files (a write that broke off) do not count.
    """
    files = stored_files(spark, root, pattern).where("length > 0")
    files = files.where(F.regexp_like("path", F.lit(layout)))
    return files.select(*[F.regexp_extract("path", layout, i).cast(kind).alias(name)
                          for i, (name, kind) in enumerate(keys.items(), 1)]).distinct()
