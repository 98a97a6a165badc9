"""Epoch logs and summary JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_log_arrays(log: DataFrame, metric: str, by: str = "run", epoch: str = "epoch",
                     value: str = "metric") -> DataFrame:
    """One row per run with parallel arrays ``epoch`` and ``<metric>`` in epoch order.

    A run's list holds its evaluated epochs only (bounded by the training length).
    """
    g = log.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(
        F.col(epoch).alias("e"), F.col(value).alias("v")))).alias("_l"))
    return g.select(by, F.transform("_l", lambda x: x["e"]).alias("epoch"),
                    F.transform("_l", lambda x: x["v"]).alias(metric))


def write_epoch_log(log: DataFrame, path: str, metric: str, by: str = "run") -> None:
    """S6 sink: JSON of parallel lists, one file per run (``run=<n>`` folders)."""
    epoch_log_arrays(log, metric, by).write.mode("overwrite").partitionBy(by).json(path)


def read_epoch_log(spark: SparkSession, path: str, metric: str, by: str = "run") -> DataFrame:
    """S6 source: parallel lists back to rows ``(run, epoch, metric)``."""
    df = spark.read.schema(f"epoch array<int>, `{metric}` array<double>, {by} int").json(path)
    z = df.select(by, F.explode(F.arrays_zip(F.col("epoch").alias("epoch"),
                                             F.col(metric).alias("metric"))).alias("z"))
    return z.select(by, F.col("z.epoch").alias("epoch"), F.col("z.metric").alias("metric"))


def _fixed(c: F.Column, digits: int | None) -> F.Column:
    """Numbers for JSON: fixed-point decimals (plain notation, no exponent) when ``digits`` is set."""
    return c.cast(f"decimal(18,{digits})") if digits is not None else c


def recall_json(recalls: DataFrame, keys=("arch", "dataset"), run: str = "run",
                value: str = "recall_at_k", digits: int | None = None) -> DataFrame:
    """``{arch, dataset, recall_at_k: [per run]}`` as one JSON string per key."""
    keys = list(keys)
    v = _fixed(F.col(value), digits)
    g = recalls.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(run), v.alias("v")))).alias("_l"))
    return g.select(*keys, F.to_json(F.struct(*[F.col(k) for k in keys],
                    F.transform("_l", lambda x: x["v"]).alias("recall_at_k"))).alias("json"))


def best_results_json(best: DataFrame, arch: str = "arch", perc_label: str = "perc_label",
                      perc_ord: str = "perc_ord", digits: int | None = None) -> DataFrame:
    """Per arch, ``{fraction: [id, ood, id_std, ood_std]}`` in fraction order."""
    def r(c):
        return _fixed(F.col(c), digits)
    g = best.groupBy(arch).agg(F.sort_array(F.collect_list(F.struct(
        F.col(perc_ord).alias("o"), F.col(perc_label).alias("k"),
        F.array(r("id_mean"), r("ood_mean"), r("id_std"), r("ood_std")).alias("v")))).alias("_l"))
    return g.select(arch, F.to_json(F.map_from_arrays(
        F.transform("_l", lambda x: x["k"]), F.transform("_l", lambda x: x["v"]))).alias("json"))


def write_json_lines(df: DataFrame, path: str, col: str = "json") -> None:
    """Write a column of JSON strings as text files."""
    df.select(col).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, col: str = "json") -> DataFrame:
    """The JSON strings written by ``write_json_lines``, one per row."""
    return spark.read.text(path).withColumnRenamed("value", col)
