"""M2: zero-shot evaluation: class vectors x items -> argmax -> metrics per split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions.vectors import argmax_class
from shiftlab.operators.metrics import group_accuracy, run_metrics
from shiftlab.operators.scoring import contrastive_scores


def zero_shot_predictions(items: DataFrame, classes: DataFrame, scale: float = 100.0,
                          run: int = 0) -> DataFrame:
    """Items scored against the class vectors, reduced to the predicted class."""
    scored = contrastive_scores(items.select("split", "item_id", "features", "y_true", "domain"),
                                classes, scale=scale)
    return scored.select(F.lit(run).alias("run"), "split", "item_id", "y_true",
                         argmax_class("scores").alias("y_pred"), "domain")


def zero_shot_split_domain(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Accuracy and count per (split, domain); the minimum slice of M2."""
    preds = zero_shot_predictions(items, classes)
    return group_accuracy(preds, ["split"], "domain")


def zero_shot_report(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Long metrics (split, metric, value) of one zero-shot run over all splits."""
    preds = zero_shot_predictions(items, classes)
    return run_metrics(preds, ["split"], "domain")
