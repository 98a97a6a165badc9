"""Streaming top-N retrieval.

Each micro-batch keeps its own best N (TakeOrderedAndProject) and merges it
with the previous state (N rows). States alternate between two slots: batch
``b`` reads slot ``(b - 1) % 2`` and overwrites slot ``b % 2``. A replayed batch
reads the same untouched previous state and rewrites its own slot with the same
rows, so the sink is idempotent, and storage stays at two states of N rows
however long the stream runs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.session import scratch_path


def slot_path(state_path: str, batch_id: int) -> str:
    return f"{state_path}/slot={batch_id % 2}"


def _read_slot(spark: SparkSession, path: str):
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018 - resolves the path
        return df
    except AnalysisException:          # slot not written yet
        return None


def latest_state(spark: SparkSession, state_path: str, before: int | None = None):
    """The newest committed top-N with a batch id below ``before`` (or overall), or None."""
    best, best_id = None, -1
    for slot in (0, 1):
        df = _read_slot(spark, f"{state_path}/slot={slot}")
        if df is None:
            continue
        bid = df.agg(F.max("batch_id")).first()[0]
        if bid is not None and (before is None or bid < before) and bid > best_id:
            best, best_id = df, bid
    return None if best is None else best.drop("batch_id")


def merge_top_n(batch: DataFrame, prev: DataFrame | None, n: int, key: str, score: str) -> DataFrame:
    cur = batch.select(key, score).orderBy(F.desc(score), F.asc(key)).limit(n)
    if prev is not None:
        cur = cur.unionByName(prev.select(key, score))
    return cur.orderBy(F.desc(score), F.asc(key)).limit(n)


def streaming_top_n(scored_stream: DataFrame, n: int, key: str = "item_id", score: str = "similarity",
                    state_path: str | None = None, checkpoint: str | None = None,
                    available_now: bool = True):
    """Run the stream to the end (``availableNow``) and return the final top-N.

    With ``available_now=False`` the stream goes on: its query handle is returned, and
    ``latest_state(spark, state_path)`` (give a ``state_path``) is the top-N so far.
    """
    spark = scored_stream.sparkSession
    state_path = state_path or scratch_path(spark, "topn-state")
    checkpoint = checkpoint or scratch_path(spark, "topn-ckpt")

    def on_batch(df: DataFrame, batch_id: int) -> None:
        prev = latest_state(spark, state_path, before=batch_id)
        merged = merge_top_n(df, prev, n, key, score).withColumn("batch_id", F.lit(batch_id).cast("long"))
        merged.coalesce(1).write.mode("overwrite").parquet(slot_path(state_path, batch_id))

    w = scored_stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    if not available_now:
        return q
    q.awaitTermination()
    final = latest_state(spark, state_path)
    if final is None:
        return spark.createDataFrame([], scored_stream.select(key, score).schema)
    return final
