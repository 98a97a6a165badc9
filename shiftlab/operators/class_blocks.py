"""P2, P3 for class sides of any size: the classes wait in storage, the items never move.

Up to ``MAX_BROADCAST_BYTES`` the class matrix is broadcast. A larger one is written to the shared
folder in blocks of that size by class id; each task reads block after block and fills
in its items' scores, so it holds one block and ``ROW_BYTES`` of scores, whatever the number of
classes, and nothing is shuffled or passed through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.operators import scoring
from shiftlab.session import scratch_path
from shiftlab.sources.tables import file_system

#: Bytes of scores that a task computes before it hands them on.
ROW_BYTES = 64 * 1024 * 1024


def _written(classes: DataFrame, rows: int) -> str:
    path = scratch_path(classes.sparkSession, "class-blocks")
    block = F.floor(F.col("id") / F.lit(rows)).cast("long")
    classes.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
    return path


def _load(path: str, block: int, normalize: bool) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.parquet as pq
    system, root = file_system(path)
    table = pq.read_table(f"{root}/block={block}", filesystem=system, columns=["id", "vec", "b"], partitioning=None)
    order = np.argsort(table["id"].to_numpy())
    w = np.stack([np.asarray(v, np.float64) for v in table["vec"].to_pylist()])[order]
    return (scoring._unit_rows(w) if normalize else w), table["b"].to_numpy().astype(np.float64)[order]


def _fill(path: str, n: int, d: int, rows: int, at: int, scale: float, normalize: bool, names: list[str]):
    def run(batches):
        blocks = -(-n // rows)
        for batch in batches:
            step = max(1, ROW_BYTES // (8 * n))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x, valid = scoring._to_matrix(part.column(at), d)
                x = scoring._unit_rows(x) if normalize else x
                scores = np.empty((len(x), n))
                for block in range(blocks):
                    w, b = _load(path, block, normalize)
                    scores[:, block * rows:block * rows + len(w)] = x @ w.T * scale + b
                yield pa.RecordBatch.from_arrays([*part.columns, scoring._to_list_array(scores, valid)], names=names)
    return run


def class_scores(items: DataFrame, classes: DataFrame, scale: float = 100.0, normalize: bool = True,
                 features: str = "features", id_col: str = "class_id", vec_col: str = "vec", bias_col: str | None = None,
                 out: str = "scores", max_bytes: int | None = None) -> DataFrame:
    """``items`` with their scores for every class as ``array<double>`` in class-id order.

    With ``normalize`` and no bias this is P2, without normalising, with a bias and scale 1 it
    is P3. Ids must be dense ``0..C-1``; a NULL vector has NULL scores. The size is measured
    first: up to ``max_bytes`` (``MAX_BROADCAST_BYTES``) the classes are broadcast, beyond it they are
    read in blocks of that size.
    """
    limit = scoring.MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    side = classes.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                          (F.col(bias_col) if bias_col else F.lit(0.0)).cast("double").alias("b"))
    small = side.persist()
    try:
        r = small.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                      F.countDistinct("id").alias("ids"), F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("least")).first()
        n, d = int(r["n"]), int(r["d"] or 0)
        if n and (r["lo"] != 0 or r["hi"] != n - 1 or r["ids"] != n):
            raise ValueError(f"class ids must be dense 0..C-1 and unique (rows={n})")
        if n and r["least"] != d:
            raise ValueError("class vectors differ in width")
        if n * d * 8 <= limit:
            rows = sorted(small.collect(), key=lambda c: c["id"])
            w = np.array([c["vec"] for c in rows], np.float64).reshape(n, d)
            b = np.array([c["b"] for c in rows], np.float64) if bias_col else None
            return scoring.scores_from_matrix(items, w, b, scale, normalize, features, out)
        per_block = max(1, limit // (8 * d))
        path = _written(small, per_block)
    finally:
        small.unpersist()
    kept = items.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(_fill(path, n, d, per_block, kept.columns.index(features), scale, normalize,
                                 [*kept.columns, out]), schema)
