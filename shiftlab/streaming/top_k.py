"""R1 per class: the top-k of every class, and its recall, over a stream.

Each task of a micro-batch first keeps its own k best rows per class, so at most k rows per
task and class reach the state. The state is keyed by class (``transformWithState``): one
value per class with its k best rows so far, kept by the state store and its checkpoint, so
a restart goes on where the stream ended and a replayed batch changes nothing. The result is
read from the state store itself; no table is written per batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftlab.operators.retrieval import _keep_best, best_rows
from shiftlab.session import scratch_path

#: The state store that keyed state of this kind needs; set while a query starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
_STATE = "top"


class KeepBest(StatefulProcessor):
    """Per class the k best rows so far; emits the class's recall whenever a batch has rows of it."""

    def __init__(self, k: int, key: str, kind: str):
        self.k, self.key, self.kind = k, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            _STATE, f"keys array<{self.kind}>, labels array<int>, probs array<double>")

    def handleInputRows(self, key, rows, timerValues):
        keys, labels, probs = [], [], []
        if self.state.exists():
            keys, labels, probs = ([np.array(x)] for x in self.state.get())
        for f in rows:
            keys.append(f[self.key].to_numpy())
            labels.append(f["y_true"].to_numpy(dtype=np.int64))
            probs.append(f["prob"].to_numpy(dtype=np.float64))           # NULL is NaN here, as in _keep_best
        if not keys:
            return
        p, i, y = best_rows(np.concatenate(probs).astype(np.float64), np.concatenate(keys), np.concatenate(labels), self.k)
        self.state.update((i.tolist(), [int(v) for v in y], [float(v) for v in p]))
        yield pd.DataFrame({"class_id": [key[0]], "held": [len(i)], "recall": [float((y == key[0]).sum()) / self.k]})

    def close(self) -> None:
        pass


def _with_provider(spark: SparkSession, action):
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, PROVIDER)
    try:
        return action()
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)


def start_top_k(probs_stream: DataFrame, k: int, checkpoint: str, key: str = "item_id", probs_col: str = "probs",
                available_now: bool = True, sink: str = "noop"):
    """Start the stream and return its query. Its updates ``(class_id, held, recall)`` go to
    ``sink`` (a streaming sink's format; by default nowhere); :func:`top_k_so_far` has the rows."""
    rows = probs_stream.select(key, "y_true", probs_col)
    kind = rows.schema[key].dataType.simpleString()
    best = rows.mapInPandas(_keep_best([], key, probs_col, k), f"`{key}` {kind}, class_id int, y_true int, prob double")
    keyed = best.groupBy("class_id").transformWithStateInPandas(
        KeepBest(k, key, kind), "class_id int, held long, recall double", outputMode="update", timeMode="none")
    writer = keyed.writeStream.format(sink).outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return _with_provider(probs_stream.sparkSession, writer.start)


def top_k_so_far(spark: SparkSession, checkpoint: str, key: str = "item_id") -> DataFrame:
    """``(class_id, rank, <key>, y_true, prob)`` after the last finished batch, from the state."""
    state = spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint)
    zipped = F.arrays_zip(F.col("value.keys").alias(key), F.col("value.labels").alias("y_true"),
                          F.col("value.probs").alias("prob"))
    rows = state.select(F.col("key.class_id").alias("class_id"), F.posexplode(zipped).alias("_at", "r"))
    return rows.select("class_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("r")[key].alias(key),
                       F.col("r.y_true").alias("y_true"), F.col("r.prob").alias("prob"))


def streaming_top_k(probs_stream: DataFrame, k: int = 20, key: str = "item_id", probs_col: str = "probs",
                    checkpoint: str | None = None) -> DataFrame:
    """T2 over a stream: run it to its end (``availableNow``) and return every class's k best
    rows. With the ``checkpoint`` of an earlier run it goes on from there."""
    spark = probs_stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "top-k-checkpoint")
    start_top_k(probs_stream, k, checkpoint, key, probs_col).awaitTermination()
    return top_k_so_far(spark, checkpoint, key)


def streaming_recall_at_k(top: DataFrame, k: int, n_classes: int) -> DataFrame:
    """T3 per class from the rows of :func:`streaming_top_k`: hits / k, 0 for classes without rows."""
    hits = top.groupBy("class_id").agg(
        (F.sum((F.col("y_true") == F.col("class_id")).cast("int")) / F.lit(float(k))).alias("recall"))
    classes = top.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id"))
    return classes.join(hits, "class_id", "left").select("class_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))
