"""M1/M3: linear probes on frozen features and limited-data learning curves."""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions.vectors import argmax_class
from shiftlab.operators.sampling import in_subset, subset_cuts
from shiftlab.operators.scoring import collect_class_matrix, linear_scores
from shiftlab.operators.selection import best_lr, curve_series
from shiftlab.operators.summaries import run_summary
from shiftlab.plans import solver

# Scans that the solver may take; it ends when the gradient is small, and says so if it does not.
MAX_STEPS = 500
# Largest gradient entry (per standardised feature) of a head that counts as converged.
GRADIENT_TOLERANCE = 1e-2


def _n_classes(train: DataFrame, n_classes: int | None) -> int:
    seen = train.agg(F.max("y_true").alias("m")).first()["m"]
    return max(n_classes or 0, 0 if seen is None else int(seen) + 1)


def head_table(spark, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """A head as a table for P3: a row per class."""
    rows = [(c, [float(x) for x in w[c]], float(b[c])) for c in range(len(b))]
    return spark.createDataFrame(rows, "class_id int, w array<double>, b double")


def fit_linear_probe(train: DataFrame, n_classes: int | None = None, max_iter: int = MAX_STEPS,
                     reg: float = 1e-3, features: str = "features") -> DataFrame:
    """M1: multinomial logistic regression on frozen features -> head ``(class_id, w, b)``.

    The same softmax cross-entropy as the reference's head training, by the solver that M3
    uses for many heads (:func:`solver.fit_heads`), until its gradient is small. Classes without
    a training row get the intercept minus infinity. The head has one row per class, so it is
    returned as a small DataFrame for P3 scoring. Raises if the solver runs out of steps.
    """
    n = _n_classes(train, n_classes)
    blocks = solver.feature_blocks(train.withColumn("_slice", F.lit("train")), F.lit(1), features, slice_col="_slice")
    fitted = solver.fit_heads(blocks, [(0, reg)], n, max_iter)[0]
    if fitted is None:
        raise ValueError("the training split has no rows")
    return head_table(train.sparkSession, fitted.w, fitted.b)


def gradient_norm(train: DataFrame, head: DataFrame, reg: float) -> float:
    """Largest entry of the objective's gradient at a head, per standardised feature: two scans."""
    w, b = collect_class_matrix(head, "class_id", "w", bias_col="b")
    blocks = solver.feature_blocks(train.withColumn("_slice", F.lit("train")), F.lit(1), slice_col="_slice")
    stats = solver.moments(blocks, [0], len(b))[0]
    sums = solver.loss_and_gradient(blocks, [(0, w, b)])[0]
    by_w, by_b = sums[1:1 + w.size].reshape(w.shape), sums[1 + w.size:]
    live = stats.spread > 0
    s = stats.spread[live]
    g = (by_w[:, live] - np.outer(by_b, stats.mean[live])) / stats.n / s + reg * s * w[:, live]
    return float(np.abs(g).max(initial=0.0))


def untrained_head(spark, n_classes: int, width: int) -> DataFrame:
    """A head before any training, as the zero-shot point of a linear-probe architecture.

    The reference's untrained head is randomly initialised; here it is all
    zeros (deterministic): every item gets equal scores, so the first class wins.
    """
    rows = [(c, [0.0] * width, 0.0) for c in range(n_classes)]
    return spark.createDataFrame(rows, "class_id int, w array<double>, b double")


def probe_predictions(items: DataFrame, head: DataFrame) -> DataFrame:
    """P3 + P5 on every item: ``(split, item_id, y_true, y_pred, domain)``."""
    s = linear_scores(items.select("split", "item_id", "features", "y_true", "domain"), head)
    return s.select("split", "item_id", "y_true", argmax_class("scores").alias("y_pred"), "domain")


def probe_report(items: DataFrame, n_classes: int | None = None, reg: float = 1e-3) -> DataFrame:
    """M1 end to end: fit on the train split; per split the rows ``n``, the share of its largest
    class ``majority``, accuracy ``acc_avg`` and mean cross-entropy ``loss`` of the head,
    ``prior_loss`` (that of guessing the training shares), and whether the head has
    ``converged`` (gradient at the head).

    The features are written once as blocks, which the fit and the evaluation scan.
    """
    is_train = F.col("split").eqNullSafe(F.lit("train"))
    blocks = solver.feature_blocks(items, is_train.cast("long"))
    n = _n_classes(items.filter(is_train), n_classes)
    fitted = solver.fit_heads(blocks, [(0, reg)], n, MAX_STEPS)[0]
    if fitted is None:
        raise ValueError("the training split has no rows")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    of_class = solver.evaluate_heads(blocks, [(fitted.w, fitted.b)]).groupBy("split", "y_true").agg(
        F.sum("n").alias("n"), F.sum(hit).alias("hits"), F.sum("loss").alias("loss"))
    prior = of_class.filter(F.col("split") == "train").select(
        F.col("y_true").alias("_c"), F.col("n").alias("_n"))                     # one row per class
    prior = prior.crossJoin(F.broadcast(prior.agg(F.sum("_n").alias("_all")))).select(
        F.col("_c").alias("y_true"), (-F.log(F.col("_n") / F.col("_all"))).alias("_guess"))
    rows = of_class.join(F.broadcast(prior), "y_true", "left").fillna(float("inf"), ["_guess"])
    return rows.groupBy("split").agg(
        F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("majority"),
        (F.sum("hits") / F.sum("n")).alias("acc_avg"), (F.sum("loss") / F.sum("n")).alias("loss"),
        (F.sum(F.col("n") * F.col("_guess")) / F.sum("n")).alias("prior_loss"),
        F.lit(fitted.gradient <= GRADIENT_TOLERANCE).alias("converged"))


def learning_curve(items: DataFrame, fractions: Sequence[float], regs: Sequence[float],
                   runs: int = 2, max_iter: int = MAX_STEPS, arch: str = "linear_probe",
                   zero_shot_head: DataFrame | None = None) -> DataFrame:
    """M3: for each (fraction, reg) and run: subset -> fit -> ID/OOD test accuracy;
    mean/std over runs; best reg per fraction by OOD test; tidy curve rows.

    All heads are fitted together: the features are written once as blocks whose rows carry
    a bit per (fraction, run) subset, each step of the solver scans them once for every
    cell still open, and one more scan evaluates all heads. With ``zero_shot_head`` the
    fraction-0 point is that head evaluated without training (one run), taken as it is by
    the selection. A fraction that keeps no training row has NULL values.
    """
    spark = items.sparkSession
    subsets = [(f, r) for f in range(len(fractions)) for r in range(runs)]
    is_train = F.col("split").eqNullSafe(F.lit("train"))
    n_classes = _n_classes(items.filter(is_train), None)
    cuts = subset_cuts(items, fractions, range(runs))
    facts = []
    for at in range(0, len(subsets), solver.MAX_SUBSETS):
        some = subsets[at:at + solver.MAX_SUBSETS]
        members = F.lit(0).cast("long")
        for i, (f, r) in enumerate(some):
            members = members.bitwiseOR(F.when(is_train & in_subset(items, cuts[f, r], r), F.lit(1 << i))
                                        .otherwise(F.lit(0)).cast("long"))
        blocks = solver.feature_blocks(items.filter(F.col("split").isin("train", "id_test", "test")), members)
        cells = [(i, o) for i in range(len(some)) for o in range(len(regs))]
        fitted = solver.fit_heads(blocks, [(i, regs[o]) for i, o in cells], n_classes, max_iter)
        heads = [(some[i][0] + 1, float(fractions[some[i][0]]), o, some[i][1], h.w, h.b)
                 for (i, o), h in zip(cells, fitted) if h is not None]
        if zero_shot_head is not None and at == 0:
            heads.append((0, 0.0, 0, 0, *collect_class_matrix(zero_shot_head, "class_id", "w", bias_col="b")))
        if not heads:
            continue
        found = solver.evaluate_heads(blocks, [h[4:] for h in heads], ["id_test", "test"])
        names = spark.createDataFrame([(c, *h[:4]) for c, h in enumerate(heads)],              # one row per head
                                      "cell int, perc_ord int, perc double, lr_ord int, run int")
        hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
        facts.append(found.groupBy("cell", "split").agg((F.sum(hit) / F.sum("n")).alias("acc_avg"))
                     .join(F.broadcast(names), "cell").drop("cell"))
    rows = spark.createDataFrame([], "split string, acc_avg double, perc_ord int, perc double, lr_ord int, run int")
    for r in facts:
        rows = rows.unionByName(r)
    summ = run_summary(rows, ["perc_ord", "perc", "lr_ord", "split"], "acc_avg")
    wide = summ.groupBy("perc_ord", "perc", "lr_ord").pivot("split", ["id_test", "test"]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    res = wide.select(F.lit(arch).alias("arch"), "perc_ord", "perc", "lr_ord",
                      F.col("id_test_mean").alias("id_mean"), F.col("test_mean").alias("ood_mean"),
                      F.col("id_test_std").alias("id_std"), F.col("test_std").alias("ood_std"))
    best = best_lr(res, zero_perc_value=0)
    asked = spark.createDataFrame(
        [(arch, fo + 1, float(f)) for fo, f in enumerate(fractions)], "arch string, perc_ord int, perc double")
    none = asked.join(best, ["arch", "perc_ord"], "left_anti")
    return curve_series(best.unionByName(none, allowMissingColumns=True))
