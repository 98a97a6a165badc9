"""Retrieval: global top-N, per-class top-k, recall@k and label lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.functions.vectors import explode_vector
from shiftlab.operators.scoring import contrastive_scores
from shiftlab.operators.threshold import select_per_class


def top_n(items: DataFrame, query: DataFrame, n: int = 5, scale: float = 100.0,
          key: str = "item_id", features: str = "features", vec_col: str = "vec") -> DataFrame:
    """The ``n`` items most similar to one query vector (``scale * cosine``).

    ``query`` holds one row with the query vector. Ties go to the smaller key.
    Each task keeps its own best ``n`` and the driver merges ``n x tasks`` rows
    (TakeOrderedAndProject); fewer than ``n`` items give fewer rows.
    """
    q = query.select(F.lit(0).alias("class_id"), F.col(vec_col).alias("vec"))
    scored = contrastive_scores(items.select(key, features), q, scale=scale)
    sim = scored.select(key, F.element_at("scores", 1).alias("similarity"))
    top = sim.orderBy(F.desc("similarity"), F.asc(key)).limit(n)
    w = Window.orderBy(F.desc("similarity"), F.asc(key))
    # at most n rows: numbering them runs on the n-row result
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def attach_labels(hits: DataFrame, items: DataFrame, classes: DataFrame, key: str = "item_id",
                  dataset: str | None = None) -> DataFrame:
    """Retrieved ids -> true label -> class name.

    ``hits`` is a top-N result (N rows): it is broadcast into the item scan,
    which it filters; the class dimension is keyed on id, never on name.
    """
    lab = items.select(key, "y_true").join(F.broadcast(hits), key)
    cls = classes
    if dataset is not None and "dataset" in classes.columns:
        cls = cls.filter(F.col("dataset") == dataset)
    cls = cls.select(F.col("class_id").alias("y_true"), "class_name")
    return lab.join(cls, "y_true", "left")


def class_probabilities(probs: DataFrame, key: str = "item_id", probs_col: str = "probs") -> DataFrame:
    """Long form ``(class_id, item_id, y_true, prob)`` of a probability table."""
    return explode_vector(probs, [key, "y_true"], probs_col, "class_id", "prob")


# Largest k that every task keeps for itself.
MAX_HELD = 4096
# Parts a class's candidates are merged in before the last merge.
MERGE_PARTS = 64


def best_rows(prob, keys, labels, k: int):
    """The ``k`` best of some rows in order: highest probability, ties by the smaller key."""
    import numpy as np
    # NaN sorts highest, as in Spark; values are compared at 12 decimals
    rank = np.where(np.isnan(prob), np.inf, np.round(prob, 12))
    if len(rank) > 2 * k:
        least = np.partition(rank, len(rank) - k)[len(rank) - k]
        near = np.flatnonzero(rank >= least)
    else:
        near = np.arange(len(rank))
    top = near[np.lexsort((keys[near], -rank[near]))][:k]
    return prob[top], keys[top], labels[top]


def _keep_best(by: list[str], key: str, probs_col: str, k: int):
    """Per task and class the ``k`` best rows over all batches (ties: smaller key)."""
    import numpy as np
    import pandas as pd

    def run(frames):
        held = {}
        for f in frames:
            f = f[f[probs_col].notna()]
            for part, g in (f.groupby(by, dropna=False, sort=False) if by else [((), f)]):
                if not len(g):
                    continue
                P = np.stack(g[probs_col].to_numpy()).astype(np.float64)
                keys, labels = g[key].to_numpy(), g["y_true"].to_numpy(dtype=np.int64)
                for c in range(P.shape[1]):
                    old = held.get((part, c))
                    new = (P[:, c], keys, labels)
                    if old is not None:
                        new = tuple(np.concatenate([a, b]) for a, b in zip(old, new))
                    held[part, c] = best_rows(*new, k)
        for (part, c), (prob, keys, labels) in held.items():
            out = {name: v for name, v in zip(by, part)}
            yield pd.DataFrame({**{name: [v] * len(keys) for name, v in out.items()}, "class_id": c, key: keys,
                                "y_true": labels, "prob": prob})
    return run


def best_per_class(probs: DataFrame, k: int, by: list[str] | None = None, key: str = "item_id",
                   probs_col: str = "probs") -> DataFrame:
    """The ``k`` best items per class (and ``by``) with their rank, for any ``k``.

    Each task keeps its own ``k`` best per class while it reads the probability
    arrays, so N x C rows are never exploded or sorted; at most ``k`` rows per task and
    class are shuffled. They are merged in ``MERGE_PARTS`` parts of a class, then once more.
    Beyond ``MAX_HELD`` rows the classes' k-th values are found first and only what
    reaches them is moved (:func:`select_per_class`).
    """
    by = list(by or [])
    if k > MAX_HELD:
        return select_per_class(probs, k, by, key, probs_col)
    rows = probs.select(*by, key, "y_true", probs_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by, key).schema.fields)
    best = rows.mapInPandas(_keep_best(by, key, probs_col, k),
                            f"{kinds}, class_id int, y_true int, prob double")
    part = F.pmod(F.xxhash64(key), F.lit(MERGE_PARTS)).alias("_part")
    order = [F.desc(F.round("prob", 12)), F.asc(key)]
    # pandas hands NaN over as NULL; it sorts highest, as in Spark
    best = best.withColumn("prob", F.coalesce("prob", F.lit(float("nan"))))
    best = best.select("*", part).repartition(*by, "class_id", "_part")
    inner = F.row_number().over(Window.partitionBy(*by, "class_id", "_part").orderBy(*order))
    best = best.withColumn("_r", inner).filter(F.col("_r") <= k).drop("_r", "_part")
    rank = F.row_number().over(Window.partitionBy(*by, "class_id").orderBy(*order))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def top_k_per_class(probs: DataFrame, k: int = 20, key: str = "item_id",
                    probs_col: str = "probs") -> DataFrame:
    """For every class the ``k`` items of highest probability (ties: smaller key)."""
    return best_per_class(probs, k, None, key, probs_col)


def recall_at_k_per_class(probs: DataFrame, k: int, n_classes: int, key: str = "item_id",
                          probs_col: str = "probs") -> DataFrame:
    """Per class, (top-k rows whose label is the class) / k.

    Divides by ``k`` even when fewer rows exist (it is precision@k). Classes
    without rows appear with 0.
    """
    top = top_k_per_class(probs, k, key, probs_col)
    hits = top.groupBy("class_id").agg(
        (F.sum((F.col("y_true") == F.col("class_id")).cast("int")) / F.lit(float(k))).alias("recall"))
    classes = probs.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id"))
    return (classes.join(hits, "class_id", "left")
                   .select("class_id", F.coalesce("recall", F.lit(0.0)).alias("recall")))


def recall_at_k(probs: DataFrame, k: int, n_classes: int, by: list[str] | None = None,
                key: str = "item_id", probs_col: str = "probs") -> DataFrame:
    """Mean recall@k over all ``n_classes`` classes, optionally per ``by`` (e.g. run)."""
    if not by:
        per = recall_at_k_per_class(probs, k, n_classes, key, probs_col)
        return per.agg((F.sum("recall") / F.lit(float(n_classes))).alias("recall_at_k"))
    top = best_per_class(probs, k, by, key, probs_col)
    hits = top.groupBy(*by).agg(F.sum((F.col("y_true") == F.col("class_id")).cast("int")).alias("hits"))
    return hits.select(*by, (F.col("hits") / F.lit(float(k)) / F.lit(float(n_classes))).alias("recall_at_k"))
