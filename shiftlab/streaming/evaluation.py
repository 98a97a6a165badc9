"""R2: streaming evaluation: prediction counts accumulated across micro-batches.

State is the confusion count per (keys, y_true, y_pred): bounded by
classes^2 x groups x splits x runs, independent of the number of items. The
complete result of batch ``b`` is written to slot ``b % 2``, so the slot of the
batch before stays whole while it is written, and a replayed batch rewrites its
own slot; metrics A1-A5 are computed on the counts like on the batch counts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.session import scratch_path
from shiftlab.streaming.top_n import latest_state, slot_path


def streaming_confusion(pred_stream: DataFrame, by: Sequence[str] = ("run", "split", "domain"),
                        out_path: str | None = None, checkpoint: str | None = None,
                        available_now: bool = True):
    """Run the stream to the end and return ``(by..., y_true, y_pred, n)``.

    With ``available_now=False`` the query handle is returned and
    ``latest_state(spark, out_path)`` holds the counts so far.
    """
    spark = pred_stream.sparkSession
    out_path = out_path or scratch_path(spark, "confusion")
    checkpoint = checkpoint or scratch_path(spark, "confusion-ckpt")
    counts = pred_stream.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))

    def on_batch(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            slot_path(out_path, batch_id))

    w = (counts.writeStream.outputMode("complete").foreachBatch(on_batch)
               .option("checkpointLocation", checkpoint))
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if not available_now:
        return q
    q.awaitTermination()
    final = latest_state(spark, out_path)
    return spark.createDataFrame([], counts.schema) if final is None else final
