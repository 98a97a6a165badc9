"""The limited-data study end to end: grid -> report files -> headline metric -> best setting per
fraction -> learning curves and result JSON (S3/J3 -> S4 -> A7 -> J5 -> T5 -> T6 -> S7)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.experiments import expand_grid, join_results, run_names
from shiftlab.operators.metrics import headline_metric_name
from shiftlab.operators.selection import best_lr

ID_SPLIT, OOD_SPLIT = "id_test", "test"


def headline_results(reports: DataFrame, dataset: str) -> DataFrame:
    """Report rows (S4) -> one row per experiment: ``name, id_mean, ood_mean, id_std, ood_std`` of
    the dataset's headline metric (A7)."""
    rows = reports.filter(F.col("metric") == headline_metric_name(F.lit(dataset)))

    def of(split, col):
        return F.first(F.when(F.col("split") == split, F.col(col)), ignorenulls=True)
    return rows.groupBy("name").agg(of(ID_SPLIT, "mean").alias("id_mean"), of(OOD_SPLIT, "mean").alias("ood_mean"),
                                    of(ID_SPLIT, "std").alias("id_std"), of(OOD_SPLIT, "std").alias("ood_std"))


def study_runs(grid: DataFrame, dataset: str, swa_archs: Sequence[str] = ()) -> DataFrame:
    """Every experiment of the study with its report name: the test grid (zero-shot rows
    included) and, for ``swa_archs``, the weight-averaged models as ``<arch>_swa``."""
    rows = run_names(expand_grid(grid, "test"), dataset)
    if swa_archs:
        swa = run_names(expand_grid(grid, "train"), dataset, swa=True).filter(F.col("arch").isin(*swa_archs))
        rows = rows.unionByName(swa.withColumn("arch", F.concat("arch", F.lit("_swa"))))
    return rows


def study_results(grid: DataFrame, reports: DataFrame, dataset: str, swa_archs: Sequence[str] = (),
                  require: bool = False) -> DataFrame:
    """Every experiment with its headline result (J5); one without a report has NULL metrics,
    or raises with ``require``."""
    return join_results(study_runs(grid, dataset, swa_archs), headline_results(reports, dataset), ["name"],
                        require=require)


def best_settings(results: DataFrame) -> DataFrame:
    """The learning rate of best OOD test result per architecture and fraction (T5)."""
    rows = results.select("arch", "perc_ord", "perc", "perc_label", "lr_ord", "lr_label",
                          "id_mean", "ood_mean", "id_std", "ood_std")
    return best_lr(rows, keys=("arch", "perc_ord"), zero_perc_value=0, perc="perc")
