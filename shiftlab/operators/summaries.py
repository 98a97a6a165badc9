"""Summaries over runs and vectors."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab import SPLIT_LABELS, SPLITS
from shiftlab.operators.tree import tree_sum

# Bytes of sums a task holds before it sends them on.
MAX_HELD_BYTES = 64 * 1024 * 1024


def run_summary(run_metrics: DataFrame, by: Sequence[str] = ("split", "metric"),
                value: str = "value") -> DataFrame:
    """Mean and *sample* std over runs (one run gives a NULL std)."""
    return run_metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.count(F.lit(1)).alias("n_runs"))


def recall_summary(recalls: DataFrame, by: Sequence[str] = (), value: str = "recall_at_k") -> DataFrame:
    """Mean and *population* std over runs (one run gives 0.0)."""
    return recalls.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.count(F.lit(1)).alias("n_runs"))


def wide_report(summary: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """A10: one row per metric, columns ``<Split label>|mean`` / ``|std`` in report order.

    The pivot values are listed, so Spark plans one aggregation and no extra
    job to discover them.
    """
    p = summary.groupBy("metric").pivot("split", list(splits)).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    cols = [F.col("metric")]
    for s in splits:
        for stat in ("mean", "std"):
            cols.append(F.col(f"{s}_{stat}").alias(f"{SPLIT_LABELS.get(s, s)}|{stat}"))
    return p.select(*cols)


def _partial_sums(by: list[str]):
    """Per task and key the sum and number of the vectors, held up to ``MAX_HELD_BYTES``."""
    import numpy as np
    import pandas as pd

    def frame(held, task):
        keys = list(held)
        cols = {name: pd.Series([k[i] for k in keys], dtype=object) for i, name in enumerate(by)}
        return pd.DataFrame({**cols, "_t": task, "_s": [held[k][0] for k in keys], "_n": [held[k][1] for k in keys]})

    def run(frames):
        from pyspark import TaskContext
        held, size, task = {}, 0, TaskContext.get().partitionId()
        for f in frames:
            for key, g in (f.groupby(by, dropna=False, sort=False) if by else [((), f)]):
                key = tuple(None if pd.isna(k) else k for k in key)
                v = np.stack(g["_v"].to_numpy()).sum(axis=0)
                if key in held:
                    held[key][0] += v
                    held[key][1] += len(g)
                else:
                    held[key] = [v, len(g)]
                    size += v.nbytes
            if size > MAX_HELD_BYTES:
                yield frame(held, task)
                held, size = {}, 0
        if held:
            yield frame(held, task)
    return run


def vector_mean(df: DataFrame, by: Sequence[str], vec: str = "v", out: str = "mean") -> DataFrame:
    """Element-wise mean of equal-width vectors per key.

    Each task adds its vectors up by key in numpy; the tasks' sums are merged as a tree
    (:func:`tree_sum`), so one key with a sum in every task is no large group. Keys may be
    many. NULL vectors do not count; a key without any has no row.
    """
    by = list(by)
    rows = df.select(*by, F.col(vec).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema.fields)
    sums = tree_sum(rows.mapInPandas(_partial_sums(by), f"{kinds}_t long, _s array<double>, _n long"), by)
    return sums.select(*by, F.transform("_s", lambda x: x / F.col("_n")).alias(out))


def swa_mean(params: DataFrame, n_epochs: int, swa_epochs: int, by: Sequence[str] = ("param",),
             epoch: str = "epoch", vec: str = "v") -> DataFrame:
    """Weight averaging over the last ``swa_epochs`` epochs (``epoch > n - swa - 1``)."""
    if not 0 < swa_epochs < n_epochs:
        raise ValueError("swa_epochs must be positive and below the number of epochs")
    return vector_mean(params.filter(F.col(epoch) > n_epochs - swa_epochs - 1), by, vec, out="v")


def class_vectors(items: DataFrame, split: str | None = "train", features: str = "features",
                  label: str = "y_true") -> DataFrame:
    """Class centroids ``(class_id, vec)``: vector mean of the features per label."""
    src = items.filter(F.col("split") == split) if split else items
    return vector_mean(src.select(F.col(label).alias("class_id"), F.col(features).alias("v")),
                       ["class_id"], "v", out="vec")
