"""M5: full evaluation report: runs x splits -> metrics -> mean/std -> wide table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.metrics import run_metrics
from shiftlab.operators.sampling import group_balanced_sample
from shiftlab.operators.summaries import run_summary, wide_report


def evaluation_summary(preds: DataFrame, group: str = "domain") -> DataFrame:
    """Long ``(split, metric, mean, std, n_runs)`` over the runs of a prediction table."""
    return run_summary(run_metrics(preds, ["run", "split"], group))


def evaluation_report(preds: DataFrame, group: str = "domain") -> DataFrame:
    """Wide report: one row per metric, ``<split>|mean`` and ``<split>|std`` columns."""
    return wide_report(evaluation_summary(preds, group))


def resample_train(preds: DataFrame, seed: int = 0, group: str = "domain", split: str = "train",
                   key: str = "item_id") -> DataFrame:
    """The predictions with the train rows of every run drawn anew, as many with replacement,
    uniformly over groups (D3): the reference evaluates its train split through such a loader.

    Run ``i`` (in order) draws with ``seed + i``; the other splits stay as they are.
    """
    inside = F.col("split").eqNullSafe(F.lit(split))
    runs = [r["run"] for r in preds.select("run").distinct().orderBy("run").collect()]        # a handful
    drawn = []
    for i, run in enumerate(runs):
        own = preds.filter(inside & F.col("run").eqNullSafe(F.lit(run)))
        drawn.append(group_balanced_sample(own, own.count(), seed + i, group, key).select(*preds.columns))
    return reduce(DataFrame.unionByName, drawn, preds.filter(~inside))


def resampled_report(preds: DataFrame, seed: int = 0, group: str = "domain") -> DataFrame:
    """M5 with the group-resampled Train column."""
    return evaluation_report(resample_train(preds, seed, group), group)
