"""Checkpoint and setting selection, curve series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Legend labels of the architectures in the learning-curve plots.
LEGEND_LABELS = {
    "resnet50_pretrained_finetune": "ResNet50 Fine-tuned (E2E)",
    "resnet50_pretrained_linearprob": "ResNet50 Linear Probe",
    "resnet50_clip_finetune": "CLIP ResNet50 Fine-tuned (E2E)",
    "resnet50_clip_linearprob": "CLIP ResNet50 Linear Probe",
    "vitb32_pretrained_finetune": "ViT-B/32 Fine-tuned (E2E)",
    "vitb32_pretrained_linearprob": "ViT-B/32 Linear Probe",
    "vitb32_clip_finetune": "CLIP ViT-B/32 Fine-tuned (E2E)",
    "vitb32_clip_linearprob": "CLIP ViT-B/32 Linear Probe",
    "vitb32_clip_finetune_swa": "CLIP ViT-B/32 Fine-tuned (E2E) w/ SWA",
}


def _clean(c: str) -> F.Column:
    """NaN -> NULL: Python's ``>`` never picks NaN, Spark would sort it highest."""
    return F.when(F.isnan(F.col(c)), F.lit(None).cast("double")).otherwise(F.col(c))


def evaluated_epochs(log: DataFrame, eval_freq: int, epoch: str = "epoch") -> DataFrame:
    """Rows of the epochs that were evaluated: epoch 0 and every ``eval_freq``-th."""
    return log.filter((F.col(epoch) == 0) | ((F.col(epoch) + 1) % eval_freq == 0))


def checkpoint_flags(log: DataFrame, eval_freq: int, by: str = "run", epoch: str = "epoch",
                     metric: str = "metric") -> DataFrame:
    """T4: flag each evaluated epoch whose metric is strictly above the best so far (start 0.0)."""
    ev = evaluated_epochs(log, eval_freq, epoch).withColumn("_m", _clean(metric))
    w = Window.partitionBy(by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.coalesce(F.max("_m").over(w), F.lit(0.0)), F.lit(0.0))
    return ev.withColumn("is_best", F.coalesce(F.col("_m") > prev, F.lit(False))).drop("_m")


def best_checkpoint(log: DataFrame, eval_freq: int, by: str = "run", epoch: str = "epoch",
                    metric: str = "metric") -> DataFrame:
    """T4: the saved ``best`` checkpoint per run = first evaluated epoch reaching the maximum.

    Runs whose metrics are all <= 0 (or NaN) have no best checkpoint. One
    aggregation: ``max(struct(metric, -epoch))``.
    """
    ev = evaluated_epochs(log, eval_freq, epoch).withColumn("_m", _clean(metric))
    ev = ev.filter(F.col("_m") > 0)
    best = ev.groupBy(by).agg(F.max(F.struct(F.col("_m"), (-F.col(epoch)).alias("_ne"))).alias("b"))
    return best.select(by, (-F.col("b._ne")).cast("int").alias("best_epoch"),
                       F.col("b._m").alias("best_metric"),
                       (-F.col("b._ne") + 1).cast("int").alias("checkpoint_epoch"))


def best_lr(results: DataFrame, keys=("arch", "perc_ord"), lr: str = "lr_ord",
            ood: str = "ood_mean", zero_perc_value: int = 0, perc: str = "perc_ord") -> DataFrame:
    """T5: per (arch, fraction) the setting with the best OOD test metric.

    Strict ``>`` from 0: ties keep the first lr in config order, and OOD <= 0
    or NaN gives no row. The zero-shot fraction takes its row as it is.
    One aggregation of ``max(struct(eligible, ood, -lr_ord, ...))`` over all
    rows (zero-shot rows are always eligible), so the input is read once.
    """
    keys = list(keys)
    others = [c for c in results.columns if c not in keys + [lr, ood]]
    o = _clean(ood)
    zero = F.col(perc) == zero_perc_value
    eligible = zero | (o > 0)
    pick = results.groupBy(*keys).agg(F.max(F.struct(
        F.coalesce(eligible, F.lit(False)).alias("_ok"),
        F.coalesce(o, F.lit(float("-inf"))).alias("_o"),
        (-F.col(lr)).alias("_nlr"), F.col(ood).alias("_ood"),
        *[F.col(c) for c in others])).alias("b"))
    return (pick.filter(F.col("b._ok"))
                .select(*keys, (-F.col("b._nlr")).cast("int").alias(lr), F.col("b._ood").alias(ood),
                        *[F.col(f"b.{c}").alias(c) for c in others]))


def curve_series(best: DataFrame, error_bars: bool = True, arch: str = "arch", perc: str = "perc",
                 legend: dict[str, str] | None = None) -> DataFrame:
    """Tidy learning-curve rows (arch, label, fraction, split, value, err).

    Splits are ``ID Test`` and ``OOD Test``; ``err`` is the std when error bars
    are asked for, else NULL. Labels come from ``legend`` (by default
    ``LEGEND_LABELS``; the arch name when absent), a small dimension that is broadcast.
    """
    spark = best.sparkSession
    labels = spark.createDataFrame(list((LEGEND_LABELS if legend is None else legend).items()), f"{arch} string, label string")
    j = best.join(F.broadcast(labels), arch, "left").withColumn(
        "label", F.coalesce(F.col("label"), F.col(arch)))
    err_id = F.col("id_std") if error_bars else F.lit(None).cast("double")
    err_ood = F.col("ood_std") if error_bars else F.lit(None).cast("double")
    stacked = j.select(arch, "label", perc, F.explode(F.array(
        F.struct(F.lit("ID Test").alias("split"), F.col("id_mean").alias("value"), err_id.alias("err")),
        F.struct(F.lit("OOD Test").alias("split"), F.col("ood_mean").alias("value"), err_ood.alias("err")),
    )).alias("s"))
    return stacked.select(arch, "label", perc, "s.split", "s.value", "s.err")
