"""M1 as it is trained over epochs: mini-batches of group-balanced draws, a log, checkpoints
and averaged weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.operators.metrics import headline_metric, run_metrics
from shiftlab.operators.sampling import domain_filter, draw_index, group_balanced_sample
from shiftlab.operators.selection import best_checkpoint
from shiftlab.operators.summaries import swa_mean
from shiftlab.plans import solver
from shiftlab.sources.tables import written

# The step schedule of the learning rate (every 15 epochs a tenth), the epochs over which
# several ranks warm up, and Adam's constants.
DECAY_EPOCHS, DECAY, WARMUP_EPOCHS = 15, 0.1, 5
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8


def learning_rates(n_epochs: int, lr: float, swa_epochs: int = 0, swa_lr: float | None = None,
                   world: int = 1) -> list[float]:
    """The rate of every epoch: steps down until weight averaging starts, then a cosine from
    the last rate to ``swa_lr`` over (at most ten of) the averaged epochs. The batches of
    ``world`` ranks together are stepped at ``world`` times the rate, reached from a single rank's
    in a straight line over ``WARMUP_EPOCHS``."""
    first = n_epochs - swa_epochs if swa_epochs else n_epochs
    warm = [1 / world + (1 - 1 / world) * min(1.0, e / WARMUP_EPOCHS) for e in range(first)]
    out = [lr * world * w * DECAY ** (e // DECAY_EPOCHS) for e, w in enumerate(warm)]
    last, length = out[-1] if out else lr, max(1, min(10, swa_epochs))
    for e in range(n_epochs - first):
        part = 0.5 * (1 + math.cos(math.pi * min(1.0, e / length)))
        out.append((swa_lr if swa_lr is not None else last) * (1 - part) + last * part)
    return out


class _Optimizer:
    """Adam or SGD with momentum on one flat vector of parameters."""

    def __init__(self, name: str, size: int, weight_decay: float, momentum: float):
        if name not in ("adam", "sgd"):
            raise ValueError(f"optimizer {name!r} is not one of adam, sgd")
        self.name, self.decay, self.momentum = name, weight_decay, momentum
        self.first, self.second, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, point: np.ndarray, gradient: np.ndarray, lr: float) -> np.ndarray:
        g = gradient + self.decay * point
        self.steps += 1
        if self.name == "sgd":
            self.first = g if self.steps == 1 else self.momentum * self.first + g
            return point - lr * self.first
        self.first = BETA_1 * self.first + (1 - BETA_1) * g
        self.second = BETA_2 * self.second + (1 - BETA_2) * g * g
        mean = self.first / (1 - BETA_1 ** self.steps)
        spread = self.second / (1 - BETA_2 ** self.steps)
        return point - lr * mean / (np.sqrt(spread) + EPSILON)


@dataclass
class Training:
    """What a training leaves behind.

    ``batches``: ``(epoch, batch, n, loss)`` with the mean loss of each batch at its step;
    ``losses``: ``(epoch, loss, n_batches)``, the mean of the batches' means (A6);
    ``heads``: ``(epoch, class_id, w, b)`` after every epoch; ``log``: ``(run, epoch, metric)``
    of the evaluated epochs (for S6); ``best``: T4's pick; ``averaged``: the mean head of the
    last ``swa_epochs`` epochs ``(class_id, w, b)`` or None.
    """

    batches: DataFrame
    losses: DataFrame
    heads: DataFrame
    log: DataFrame
    best: DataFrame
    averaged: DataFrame | None


def train_head(items: DataFrame, n_classes: int, n_epochs: int, batch_size: int, lr: float, optimizer: str = "adam",
               weight_decay: float = 0.0, momentum: float = 0.9, swa_epochs: int = 0, swa_lr: float | None = None,
               eval_freq: int = 1, eval_split: str = "val", dataset: str = "items", group: str = "domain",
               group_id: int | None = None, seed: int = 0, run: int = 1, key: str = "item_id",
               world: int = 1) -> Training:
    """Train a softmax head on frozen features by mini-batches.

    Each epoch draws as many rows as the train split has, uniformly over groups (D3), and cuts
    them into batches in order of the draws (D5; the last one is short). The drawn rows are
    dealt once into blocks, each batch in partitions of its own, so a step is a job without a
    shuffle that reads its batch alone. At most 64 vectors a step reach the driver, which holds
    the head, the optimizer's state and a loss per step. With ``group_id`` only that group
    is trained on (F1). Epoch 0 and every ``eval_freq``-th one are evaluated on ``eval_split``
    by the dataset's headline metric (A7), all in one scan. ``swa_epochs`` averages the heads of
    the last epochs (A11). ``batch_size`` rows are one step; ``world`` scales the rate for batches
    that stand for those of several ranks. Draws depend on ``seed``, ``run`` and the epoch alone.
    """
    if batch_size <= 0 or n_epochs <= 0 or eval_freq <= 0:
        raise ValueError("batch_size, n_epochs and eval_freq must be positive")
    if swa_epochs and not 0 < swa_epochs < n_epochs:
        raise ValueError("swa_epochs must be below the number of epochs")
    spark = items.sparkSession
    train = domain_filter(items.filter(F.col("split") == "train"), group_id, group=group)
    train = written(train.filter("features is not null and y_true is not null")
                    .select(key, "features", "y_true", group), "training-rows")       # read once per epoch
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    n, width = shape["n"], shape["d"]
    if not n:
        raise ValueError("the training split has no rows")
    index = draw_index(train, group, key)
    point = np.zeros(n_classes * (width + 1))
    state = _Optimizer(optimizer, len(point), weight_decay, momentum)
    n_batches, parts = -(-n // batch_size), solver.batch_parts(min(batch_size, n), len(point))
    batches, heads = [], []

    def head_of(p):
        return p[:n_classes * width].reshape(n_classes, width), p[n_classes * width:]

    for epoch, rate in enumerate(learning_rates(n_epochs, lr, swa_epochs, swa_lr, world)):
        draws = group_balanced_sample(train, n, seed=seed + 1_000_003 * run + epoch, group=group, key=key, index=index)
        blocks = solver.batch_blocks(draws, batch_size, n_batches, parts)
        blocks.count()                                            # all batches at once, not one by one
        for batch in range(n_batches):
            sums = solver.batch_sums(blocks, list(range(batch * parts, (batch + 1) * parts)), *head_of(point))
            rows = min(batch_size, n - batch * batch_size)
            batches.append((epoch, batch, rows, float(sums[0]) / rows))
            point = state.step(point, sums[1:] / rows, rate)
        blocks.unpersist()
        heads.append(point.copy())

    evaluated = [e for e in range(n_epochs) if e == 0 or (e + 1) % eval_freq == 0]
    held_out = solver.feature_blocks(items.filter(F.col("split") == eval_split).select("split", "features", "y_true"),
                                     F.lit(0))
    counts = solver.evaluate_heads(held_out, [head_of(heads[e]) for e in evaluated])
    names = spark.createDataFrame(list(enumerate(evaluated)), "cell int, epoch int")            # one row per epoch
    counts = counts.join(F.broadcast(names), "cell").withColumn("domain", F.lit(0))
    metric = headline_metric(run_metrics(None, ["epoch"], counts=counts).withColumn("dataset", F.lit(dataset)))
    log = metric.select(F.lit(run).alias("run"), "epoch", F.col("value").alias("metric"))
    log = spark.createDataFrame(log.collect(), "run int, epoch int, metric double")             # one row per epoch
    table = spark.createDataFrame(
        [(e, c, [float(x) for x in w[c]], float(b[c])) for e, p in enumerate(heads) for w, b in [head_of(p)]
         for c in range(n_classes)], "epoch int, class_id int, w array<double>, b double")
    averaged = None
    if swa_epochs:
        params = table.select(F.col("class_id").alias("param"), "epoch", F.concat("w", F.array("b")).alias("v"))
        averaged = swa_mean(params, n_epochs, swa_epochs).select(
            F.col("param").alias("class_id"), F.slice("v", 1, width).alias("w"), F.element_at("v", -1).alias("b"))
    steps = spark.createDataFrame(batches, "epoch int, batch int, n int, loss double")
    losses = steps.groupBy("epoch").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))
    return Training(steps, losses, table, log, best_checkpoint(log, eval_freq), averaged)
