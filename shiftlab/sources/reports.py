"""Wide evaluation reports as CSV (two header rows), and reading them back.

Layout of one report: header row 1 ``,Train,Train,ID Val,ID Val,...``, header
row 2 ``,mean,std,mean,std,...``, then one row per metric. Many experiments are
written in one job, one folder per experiment (``name=<experiment>``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab import SPLIT_LABELS, SPLITS


def _header_rows(spark: SparkSession, splits: Sequence[str]):
    labels = [SPLIT_LABELS[s] for s in splits]
    h1 = [""] + [x for lab in labels for x in (lab, lab)]
    h2 = [""] + ["mean", "std"] * len(labels)
    return [h1, h2]


def write_reports(summary: DataFrame, path: str, name_col: str | None = "name",
                  splits: Sequence[str] = SPLITS) -> None:
    """Wide reports of a long summary ``([name,] split, metric, mean, std)``.

    Each experiment's report is small (metrics x 10 values); the header rows
    are added per experiment and the rows ordered inside the one output file
    of its folder. The folder is created if absent and overwritten.
    """
    spark = summary.sparkSession
    keys = [name_col] if name_col else []
    wide = (summary.groupBy(*keys, "metric").pivot("split", list(splits))
                   .agg(F.first("mean").alias("mean"), F.first("std").alias("std")))
    vals = [F.col("metric").alias("c0")]
    i = 1
    for s in splits:
        for stat in ("mean", "std"):
            vals.append(F.col(f"{s}_{stat}").cast("string").alias(f"c{i}"))
            i += 1
    body = wide.select(*keys, F.lit(2).alias("_o"), *vals)
    h = _header_rows(spark, splits)
    width = 1 + 2 * len(splits)
    hdr = spark.createDataFrame([(0, *h[0]), (1, *h[1])], ["_o"] + [f"c{j}" for j in range(width)])
    if keys:
        hdr = _per_name_headers(summary, name_col, hdr)
    out = body.unionByName(hdr.select(*keys, "_o", *[f"c{j}" for j in range(width)]))
    if keys:
        out = out.repartition(name_col).sortWithinPartitions(name_col, "_o", "c0")
        out.drop("_o").write.mode("overwrite").partitionBy(name_col).option("emptyValue", "").csv(path)
    else:
        out.repartition(1).sortWithinPartitions("_o", "c0").drop("_o") \
           .write.mode("overwrite").option("emptyValue", "").csv(path)


def _per_name_headers(summary: DataFrame, name_col: str, hdr: DataFrame) -> DataFrame:
    """The two header rows for every experiment name (explode of the two rows)."""
    rows = hdr.orderBy("_o").collect()
    arr = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in hdr.columns]) for r in rows])
    return summary.select(name_col).distinct().select(name_col, F.explode(arr).alias("h")) \
                  .select(name_col, "h.*")


def write_report(summary: DataFrame, path: str, splits: Sequence[str] = SPLITS) -> None:
    """S5 for one experiment: ``(split, metric, mean, std)`` -> one wide CSV."""
    write_reports(summary, path, name_col=None, splits=splits)


def write_summary_parquet(summary: DataFrame, path: str, arch_col: str = "arch") -> None:
    """S5, long form: all summary rows as Parquet, a folder per architecture."""
    summary.write.mode("overwrite").partitionBy(arch_col).parquet(path)


def read_summary_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The long summary back; a filter on the architecture reads its folder only."""
    return spark.read.parquet(path)


def read_reports(spark: SparkSession, path: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Long rows ``(file, [name,] metric, split, mean, std)`` from wide report CSVs.

    Both header rows have an empty first field, so they drop out with the
    ``metric is not null`` filter. In each split the first column is the mean
    and the second the std.
    """
    schema = ", ".join(f"c{j} string" for j in range(1 + 2 * len(splits)))
    df = spark.read.schema(f"{schema}, name string").option("basePath", path).csv(path)
    df = df.withColumn("file", F.col("_metadata.file_path"))
    df = df.filter(F.col("c0").isNotNull() & (F.col("c0") != ""))
    pairs = []
    for i, s in enumerate(splits):
        pairs += [F.lit(s), F.col(f"c{2 * i + 1}").cast("double"), F.col(f"c{2 * i + 2}").cast("double")]
    stacked = df.select("file", "name", F.col("c0").alias("metric"), F.explode(F.array(*[
        F.struct(pairs[3 * j].alias("split"), pairs[3 * j + 1].alias("mean"), pairs[3 * j + 2].alias("std"))
        for j in range(len(splits))])).alias("s"))
    # the name is the partition column of the folders written by write_reports (NULL without)
    return stacked.select("file", "metric", "s.split", "s.mean", "s.std", "name")
