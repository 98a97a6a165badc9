"""M4: retrieval evaluation over runs: score -> softmax -> recall@k -> mean/std -> JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions.vectors import softmax
from shiftlab.operators.retrieval import recall_at_k
from shiftlab.operators.scoring import contrastive_scores
from shiftlab.operators.summaries import recall_summary


def run_probabilities(items: DataFrame, run_classes: DataFrame, n_runs: int, n_classes: int,
                      scale: float = 100.0) -> DataFrame:
    """Probabilities of every item under every run's class vectors, in one scan.

    ``run_classes(run, class_id, vec)`` is stacked into one matrix (row
    ``run * C + class_id``), broadcast once; each run's slice of the score
    array is then soft-maxed. ``(run, item_id, y_true, probs)``.
    """
    stacked = run_classes.select(
        (F.col("run") * n_classes + F.col("class_id")).cast("int").alias("class_id"), "vec")
    scored = contrastive_scores(items.select("item_id", "features", "y_true"), stacked, scale=scale)
    # slice each run's scores before exploding, so an output row carries C values, not runs x C;
    # the outer generator keeps Catalyst from re-evaluating the Python scores for a size filter
    runs = F.transform(F.sequence(F.lit(0), F.lit(n_runs - 1)), lambda r: F.struct(
        r.alias("run"), F.slice("scores", r * n_classes + 1, F.lit(n_classes)).alias("s")))
    per_run = (scored.select("item_id", "y_true", F.explode_outer(runs).alias("x"))
                     .filter(F.col("x").isNotNull()))
    return per_run.select(F.col("x.run").cast("int").alias("run"), "item_id", "y_true",
                          softmax(F.col("x.s")).alias("probs"))


def retrieval_recalls(items: DataFrame, run_classes: DataFrame, n_runs: int, n_classes: int,
                      k: int = 20, split: str = "test") -> DataFrame:
    """Recall@k per run on one split (default the OOD test split)."""
    ev = items.filter(F.col("split") == split)
    probs = run_probabilities(ev, run_classes, n_runs, n_classes)
    return recall_at_k(probs, k, n_classes, by=["run"])


def retrieval_report(items: DataFrame, run_classes: DataFrame, n_runs: int, n_classes: int,
                     k: int = 20, split: str = "test") -> DataFrame:
    """Mean and population std of recall@k over runs."""
    return recall_summary(retrieval_recalls(items, run_classes, n_runs, n_classes, k, split))
