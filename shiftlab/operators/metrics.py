"""Evaluation metrics over prediction tables.

A prediction table has at least ``y_true int, y_pred int`` plus grouping
columns (``run``, ``split``, ``domain`` ...). Every metric starts from one
partial-aggregated count, so the shuffle carries (keys x classes^2) rows at
most, never item rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.functions.vectors import cross_entropy

BY = ("run", "split")


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def accuracy(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A1: top-1 accuracy (metric ``acc_avg``) and row count per slice."""
    by = _by(by)
    return preds.groupBy(*by).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc_avg"),
        F.count(F.lit(1)).alias("n"))


def group_accuracy(preds: DataFrame, by: Sequence[str] = BY, group: str = "domain") -> DataFrame:
    """A2: accuracy and count per group inside each slice."""
    by = _by(by)
    return preds.groupBy(*by, group).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"),
        F.count(F.lit(1)).alias("n"))


def worst_group(preds: DataFrame, by: Sequence[str] = BY, group: str = "domain") -> DataFrame:
    """A3: worst-group accuracy = minimum over groups with rows; ties go to the lowest group id."""
    by = _by(by)
    g = group_accuracy(preds, by, group).filter(F.col("n") > 0)
    m = F.min(F.struct(F.col("acc"), F.col(group)))
    return g.groupBy(*by).agg(m.alias("w")).select(
        *by, F.col("w.acc").alias("acc_wg"), F.col(f"w.{group}").alias("worst_group"))


def confusion(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A4: counts per (slice, y_true, y_pred): the sufficient statistic of A1 and A5."""
    by = _by(by)
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _class_roles(cm: DataFrame, by: list[str]) -> DataFrame:
    """Per (slice, class): support, predicted and true positives, from confusion counts.

    Each count row is exploded into its true-class role and its predicted-class
    role and summed once: one aggregation, no join of three aggregates.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    roles = F.explode(F.array(
        F.struct(F.col("y_true").alias("class_id"), F.col("n").cast("bigint").alias("s"),
                 zero.alias("p"), hit.cast("bigint").alias("t")),
        F.struct(F.col("y_pred").alias("class_id"), zero.alias("s"),
                 F.col("n").cast("bigint").alias("p"), zero.alias("t"))))
    return (cm.select(*by, roles.alias("r"))
              .groupBy(*by, F.col("r.class_id").alias("class_id"))
              .agg(F.sum("r.s").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.t").alias("tp")))


def per_class_prf(preds: DataFrame, by: Sequence[str] = BY, counts: DataFrame | None = None) -> DataFrame:
    """A5: precision, recall and F1 per class present in ``y_true`` of the slice.

    ``precision = tp / predicted``, ``recall = tp / support`` and
    ``f1 = 2 tp / (support + predicted)``; 0/0 counts as 0.
    """
    by = _by(by)
    cm = counts if counts is not None else confusion(preds, by)
    c = _class_roles(cm, by).filter(F.col("support") > 0)
    return c.select(
        *by, F.col("class_id").cast("int").alias("class_id"), "tp", "support", "predicted",
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")).cast("double"), F.lit(0.0)).alias("precision"),
        (F.col("tp") / F.col("support")).cast("double").alias("recall"),
        (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).cast("double").alias("f1"))


def macro_f1(preds: DataFrame, by: Sequence[str] = BY, counts: DataFrame | None = None) -> DataFrame:
    """A5: macro F1 (metric ``F1-macro_all``) over the classes present in ``y_true``."""
    by = _by(by)
    return per_class_prf(preds, by, counts).groupBy(*by).agg(F.avg("f1").alias("f1_macro"))


def slice_metrics(preds: DataFrame | None, by: Sequence[str] = BY, group: str = "domain",
                  counts: DataFrame | None = None) -> DataFrame:
    """acc_avg, acc_wg and F1-macro_all per slice in one linear pipeline.

    One shuffle of the predictions (partial-aggregated counts per slice, group
    and label pair), then each count row is exploded into its group role and
    its two class roles, summed per (slice, role, key), and reduced per slice.
    The big input is read once; later shuffles carry count rows only.
    ``counts`` (``by..., group, y_true, y_pred, n``, e.g. a streaming sink) may
    replace the predictions.
    """
    by = _by(by)
    if counts is not None:
        cm = counts.groupBy(*by, group, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    else:
        cm = preds.groupBy(*by, group, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("bigint")
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    # the group keeps its own type (a string, a double, NULL) in a field of its own
    no_group = F.lit(None).cast(cm.schema[group].dataType)
    no_class = F.lit(None).cast("bigint")

    def role(name, g, c, hits, rows, sup, pred, tp):
        return F.struct(F.lit(name).alias("role"), g.alias("g"), c.cast("bigint").alias("c"), hits.alias("h"),
                        rows.alias("n"), sup.alias("s"), pred.alias("p"), tp.alias("t"))
    roles = F.explode(F.array(
        role("g", F.col(group), no_class, hit, n, zero, zero, zero),
        role("c", no_group, F.col("y_true"), zero, zero, n, zero, hit),
        role("c", no_group, F.col("y_pred"), zero, zero, zero, n, zero)))
    per_key = (cm.select(*by, roles.alias("r"))
                 .groupBy(*by, F.col("r.role").alias("role"), F.col("r.g").alias("g"), F.col("r.c").alias("c"))
                 .agg(F.sum("r.h").alias("h"), F.sum("r.n").alias("n"), F.sum("r.s").alias("s"),
                      F.sum("r.p").alias("p"), F.sum("r.t").alias("t")))
    is_g = F.col("role") == "g"
    is_c = (F.col("role") == "c") & (F.col("s") > 0)
    return per_key.groupBy(*by).agg(
        (F.sum(F.when(is_g, F.col("h"))) / F.sum(F.when(is_g, F.col("n")))).alias("acc_avg"),
        F.min(F.when(is_g & (F.col("n") > 0), F.col("h") / F.col("n"))).alias("acc_wg"),
        F.avg(F.when(is_c, 2 * F.col("t") / (F.col("s") + F.col("p")))).alias("f1_macro"),
        F.sum(F.when(is_g, F.col("n"))).alias("n"))


def run_metrics(preds: DataFrame | None, by: Sequence[str] = BY, group: str = "domain",
                counts: DataFrame | None = None) -> DataFrame:
    """Long metric table ``(by..., metric, value)``: acc_avg, acc_wg, F1-macro_all."""
    by = _by(by)
    wide = slice_metrics(preds, by, group, counts)
    long = F.explode(F.array(
        F.struct(F.lit("acc_avg").alias("metric"), F.col("acc_avg").alias("value")),
        F.struct(F.lit("acc_wg").alias("metric"), F.col("acc_wg").alias("value")),
        F.struct(F.lit("F1-macro_all").alias("metric"), F.col("f1_macro").alias("value"))))
    return wide.select(*by, long.alias("m")).select(*by, "m.metric", "m.value")


def epoch_loss(scored: DataFrame, by: Sequence[str], batch: str = "batch",
               scores: str = "scores", label: str = "y_true", row_loss: str | None = None) -> DataFrame:
    """Mean over batches of the batch-mean softmax cross-entropy.

    A short last batch weighs as much as a full one (mean of means). ``row_loss`` names a
    column that holds the rows' cross-entropy already.
    """
    by = _by(by)
    ce = scored.select(*by, batch, (F.col(row_loss) if row_loss else cross_entropy(scores, label)).alias("ce"))
    per_batch = ce.groupBy(*by, batch).agg(F.avg("ce").alias("batch_loss"))
    return per_batch.groupBy(*by).agg(F.avg("batch_loss").alias("loss"),
                                      F.count(F.lit(1)).alias("n_batches"))


def headline_metric_name(dataset: F.Column | str) -> F.Column:
    """``F1-macro_all`` for a dataset whose name contains iwildcam, else ``acc_avg``."""
    d = F.col(dataset) if isinstance(dataset, str) else dataset
    return F.when(d.contains("iwildcam"), F.lit("F1-macro_all")).otherwise(F.lit("acc_avg"))


def headline_metric(metrics: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Keep each dataset's headline metric rows of a long metric table."""
    return metrics.filter(F.col("metric") == headline_metric_name(dataset_col))


def dataset_summary(items: DataFrame, batch_size: int = 128, group: str = "domain") -> DataFrame:
    """Rows, batches, classes and groups per split, and the total row count."""
    per = items.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("y_true").alias("n_classes"),
        F.countDistinct(group).alias("n_groups"))
    per = per.withColumn("n_batches", F.ceil(F.col("n_rows") / F.lit(batch_size)).cast("bigint"))
    # one row per split: the whole-table window runs on the small per-split table
    total = F.sum("n_rows").over(Window.partitionBy())
    return per.select("split", "n_rows", "n_batches", "n_classes", "n_groups",
                      total.cast("bigint").alias("n_total"))


def rows_per_group(items: DataFrame, group: str = "domain") -> DataFrame:
    """Item count per (split, group)."""
    return items.groupBy("split", group).agg(F.count(F.lit(1)).alias("n_rows"))
