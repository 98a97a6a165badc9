"""Scoring of item vectors against class vectors or a linear head.

The class side is a vocabulary: its size does not grow with the item table.
It is collected once behind an explicit size check and shipped as a broadcast
variable; each task multiplies whole Arrow batches of item vectors with it in
numpy (zero-copy from the Arrow buffers). The item side is never shuffled.

``contrastive_scores`` and ``linear_scores`` are this form and refuse a class side above the
bound. ``class_blocks.class_scores`` serves any size (beyond the bound the classes are read
from storage block by block), and so do ``score_pairs`` and ``predict_table``, which use it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.functions.vectors import explode_vector, softmax

# Largest class matrix (classes x width x 8 bytes) that is broadcast whole.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


class ClassMatrixTooLarge(ValueError):
    """The class side exceeds the broadcast bound."""


def _class_stats(classes: DataFrame, vec_col: str) -> tuple[int, int]:
    """Rows and widest vector of the class side (one single-stage aggregation)."""
    r = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    return int(r["n"]), int(r["d"] or 0)


def collect_class_matrix(classes: DataFrame, id_col: str = "class_id", vec_col: str = "vec",
                         bias_col: str | None = None,
                         max_bytes: int = MAX_BROADCAST_BYTES):
    """Collect a dense class matrix (row i = class id i) after checking its size.

    Class ids must be dense ``0..C-1``; the score array is indexed by class id.
    Returns ``(W, b)`` with ``b`` None when no bias column is given.
    """
    cols = [F.col(id_col), F.col(vec_col).cast("array<double>").alias("vec")]
    if bias_col:
        cols.append(F.col(bias_col).cast("double").alias("b"))
    # the class side is usually an aggregate (centroids, a fitted head): keep it
    # for the size check and the collection instead of computing it twice
    small = classes.select(*cols).persist()
    try:
        n, d = _class_stats(small, "vec")
        if n * d * 8 > max_bytes:
            raise ClassMatrixTooLarge(
                f"class matrix {n} x {d} exceeds the broadcast bound of {max_bytes} bytes; "
                "use score_pairs (blocked long form)")
        rows = small.collect()
    finally:
        small.unpersist()
    rows.sort(key=lambda r: r[id_col])
    ids = [r[id_col] for r in rows]
    if ids != list(range(n)):
        raise ValueError(f"class ids must be dense 0..C-1 and unique (rows={n})")
    W = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(n, d)
    b = np.array([r["b"] for r in rows], dtype=np.float64) if bias_col else None
    return W, b


def _unit_rows(M: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return M / np.linalg.norm(M, axis=1, keepdims=True)


def _to_matrix(v: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list array -> (n_valid x d float64 matrix, validity mask)."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    valid = np.asarray(v.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    if not valid.all():
        v = v.filter(pa.array(valid))
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != d).any():
        raise ValueError(f"vector width differs from the class width {d}")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(v), d), valid


def _to_list_array(S: np.ndarray, valid: np.ndarray) -> pa.Array:
    n_all = len(valid)
    c = S.shape[1] if S.ndim == 2 else 0
    lens = np.where(valid, c, 0)
    offsets = np.zeros(n_all + 1, dtype=np.int32)
    np.cumsum(lens, out=offsets[1:])
    mask = pa.array(~valid) if not valid.all() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(S.ravel(), pa.float64()), mask=mask)


def _score_kernel(bc, scale: float, normalize: bool):
    def kernel(v: pa.Array) -> pa.Array:
        W, b = bc.value
        X, valid = _to_matrix(v, W.shape[1])
        if normalize:
            X = _unit_rows(X)
        S = X @ W.T
        if scale != 1.0:
            S = S * scale
        if b is not None:
            S = S + b
        return _to_list_array(S, valid)
    return F.arrow_udf(kernel, T.ArrayType(T.DoubleType()))


def contrastive_scores(items: DataFrame, classes: DataFrame, scale: float = 100.0,
                       normalize: bool = True, features: str = "features",
                       id_col: str = "class_id", vec_col: str = "vec",
                       out: str = "scores", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``scale * <x/|x|, t/|t|>`` for every item and class, as ``array<double>`` in class-id order.

    With ``normalize=False`` the raw inner product times ``scale`` is returned
    (a learned-scale model passes its own ``scale``).
    """
    W, _ = collect_class_matrix(classes, id_col, vec_col, max_bytes=max_bytes)
    if normalize:
        W = _unit_rows(W)
    bc = items.sparkSession.sparkContext.broadcast((W, None))
    udf = _score_kernel(bc, scale, normalize)
    return items.withColumn(out, udf(F.col(features)))


def scores_from_matrix(items: DataFrame, W: np.ndarray, b: np.ndarray | None = None,
                       scale: float = 1.0, normalize: bool = False, features: str = "features",
                       out: str = "scores") -> DataFrame:
    """Score items with an already collected (size-checked) class matrix ``W`` (and bias ``b``).

    With ``normalize`` both the items and the rows of ``W`` are L2-normalised.
    """
    W = _unit_rows(W) if normalize else W
    bc = items.sparkSession.sparkContext.broadcast((W, b))
    return items.withColumn(out, _score_kernel(bc, scale, normalize)(F.col(features)))


def linear_scores(items: DataFrame, head: DataFrame, features: str = "features",
                  id_col: str = "class_id", w_col: str = "w", b_col: str = "b",
                  out: str = "scores", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``W x + b`` of a linear head ``head(class_id, w, b)`` on frozen features."""
    W, b = collect_class_matrix(head, id_col, w_col, bias_col=b_col, max_bytes=max_bytes)
    bc = items.sparkSession.sparkContext.broadcast((W, b))
    udf = _score_kernel(bc, 1.0, False)
    return items.withColumn(out, udf(F.col(features)))


def contrastive_scores_native(items: DataFrame, classes: DataFrame, scale: float = 100.0,
                              features: str = "features", id_col: str = "class_id",
                              vec_col: str = "vec", out: str = "scores",
                              max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """P2 without Python: the normalised class matrix is a literal array of arrays.

    Used to cross-check the Arrow path; it stays inside whole-stage codegen but
    is slower on wide vectors.
    """
    W, _ = collect_class_matrix(classes, id_col, vec_col, max_bytes=max_bytes)
    W = _unit_rows(W)
    mat = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in W])
    x = F.col(features).cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e * e))
    score = F.transform(mat, lambda w: F.aggregate(
        F.zip_with(x, w, lambda a, c: a * c), F.lit(0.0), lambda acc, e: acc + e) / norm * scale)
    return items.withColumn(out, score)


def predict_table(items: DataFrame, classes: DataFrame | None = None, head: DataFrame | None = None,
                  scale: float = 100.0, max_bytes: int | None = None) -> DataFrame:
    """Probability vector and true label per item (contrastive or linear scorer), for class
    sides of any size."""
    from shiftlab.operators.class_blocks import class_scores
    if head is not None:
        scored = class_scores(items, head, 1.0, False, vec_col="w", bias_col="b", max_bytes=max_bytes)
    else:
        scored = class_scores(items, classes, scale=scale, max_bytes=max_bytes)
    return scored.select("item_id", "y_true", softmax("scores").alias("probs"))


# Output rows one cell of the blocked product may produce (items x classes of the cell).
CELL_PAIRS = 4_000_000


def _cell_kernel(item_col: str, id_col: str, features: str, vec_col: str, scale: float,
                 normalize: bool):
    import pandas as pd

    def kernel(left: "pd.DataFrame", right: "pd.DataFrame") -> "pd.DataFrame":
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({item_col: pd.Series([], dtype="int64"),
                                 "class_id": pd.Series([], dtype="int32"),
                                 "score": pd.Series([], dtype="float64")})
        X = np.stack(left[features].to_numpy()).astype(np.float64)
        W = np.stack(right[vec_col].to_numpy()).astype(np.float64)
        if normalize:
            X, W = _unit_rows(X), _unit_rows(W)
        S = (X @ W.T) * scale
        return pd.DataFrame({
            item_col: np.repeat(left[item_col].to_numpy(dtype=np.int64), len(right)),
            "class_id": np.tile(right[id_col].to_numpy(dtype=np.int32), len(left)),
            "score": S.ravel()})
    return kernel


def predict_table_ordered(items: DataFrame, classes: DataFrame | None = None,
                          head: DataFrame | None = None, scale: float = 100.0,
                          order="item_id") -> tuple[DataFrame, int]:
    """P6 with the row position: ``(idx, item_id, y_true, probs)`` in the stated order, and the row count.

    The position is the distributed dense index (D6); the count comes with it.
    """
    from shiftlab.operators.sampling import with_index_and_count
    probs = predict_table(items, classes, head, scale)
    return with_index_and_count(probs, order)


def write_predictions(probs: DataFrame, table: str, buckets: int = 16, key: str = "item_id",
                      path: str | None = None) -> int:
    """P6 written for later joins: a catalogue table bucketed and sorted by ``key``, so the
    predictions of several runs meet without a shuffle. Its files lie under ``path`` (by
    default in the shared checkpoint folder). Returns the number of rows, which is
    observed while they are written: the input is scanned once."""
    from pyspark.sql import Observation

    from shiftlab.session import scratch_path
    seen = Observation()
    (probs.observe(seen, F.count(F.lit(1)).alias("n")).repartition(buckets, key)
          .write.mode("overwrite").option("path", path or scratch_path(probs.sparkSession, "predictions"))
          .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return int(seen.get["n"])


def join_predictions(spark, tables: dict[str, str], key: str = "item_id") -> DataFrame:
    """The probability vectors of several runs side by side: ``key``, ``y_true``, one column per
    entry of ``tables`` (name -> table written by :func:`write_predictions`)."""
    out = None
    for name, table in tables.items():
        own = spark.table(table).select(key, "y_true", F.col("probs").alias(name))
        out = own if out is None else out.join(own.drop("y_true"), key)
    return out


def score_pairs_blocked(items: DataFrame, classes: DataFrame, scale: float = 100.0,
                        normalize: bool = True, features: str = "features", item_col: str = "item_id",
                        id_col: str = "class_id", vec_col: str = "vec",
                        cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """J1 for a class side of any size: a distributed blocked product.

    Items and classes are cut into blocks of about ``sqrt(CELL_PAIRS)`` rows by their
    dense index, so no cell (item block, class block) yields more than ``CELL_PAIRS``
    scores, whatever the keys. Every row is copied once per block of the other side, and
    one ``cogroup`` per cell multiplies two small matrices in numpy. Rows without a
    vector are dropped, as in the broadcast form.
    """
    from shiftlab.operators.sampling import with_index_and_count
    side = max(1, math.isqrt(cell_pairs))
    left, n = with_index_and_count(items.select(F.col(item_col).cast("long").alias(item_col), features)
                                   .filter(F.col(features).isNotNull()), item_col, out="_i")
    right, m = with_index_and_count(classes.select(F.col(id_col).cast("int").alias(id_col), F.col(vec_col))
                                    .filter(F.col(vec_col).isNotNull()), id_col, out="_j")
    last_i, last_j = max(-(-n // side) - 1, 0), max(-(-m // side) - 1, 0)
    left = (left.withColumn("_s", F.expr(f"_i div {side}"))
                .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(last_j)).cast("array<bigint>"))))
    right = (right.withColumn("_blk", F.expr(f"_j div {side}"))
                  .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(last_i)).cast("array<bigint>"))))
    schema = f"{item_col} long, class_id int, score double"
    kernel = _cell_kernel(item_col, id_col, features, vec_col, scale, normalize)
    return left.groupBy("_blk", "_s").cogroup(right.groupBy("_blk", "_s")).applyInPandas(kernel, schema)


def score_pairs(items: DataFrame, classes: DataFrame, scale: float = 100.0,
                normalize: bool = True, features: str = "features", item_col: str = "item_id",
                id_col: str = "class_id", vec_col: str = "vec",
                max_bytes: int | None = None) -> DataFrame:
    """Long form ``(item_id, class_id, score)`` of the item x class product.

    The scores of :func:`class_scores`, for class sides of any size, exploded with their
    position. (``score_pairs_blocked`` is for items that should meet the classes in cells.)
    """
    from shiftlab.operators.class_blocks import class_scores
    scored = class_scores(items.select(item_col, features), classes, scale, normalize, features, id_col, vec_col,
                          max_bytes=max_bytes)
    return explode_vector(scored, item_col, "scores", "class_id", "score")
