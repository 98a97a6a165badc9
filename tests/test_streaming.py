import os
import tempfile

from pyspark.sql import functions as F

from shiftlab.operators import metrics, retrieval, scoring, summaries
from shiftlab.sources import fixtures as fx
from shiftlab.streaming.evaluation import streaming_confusion
from shiftlab.streaming.top_k import start_top_k, streaming_recall_at_k, streaming_top_k, top_k_so_far
from shiftlab.streaming.top_n import streaming_top_n
from conftest import SF_SMALL


def test_streaming_top_n_equals_batch_over_many_batches(spark):
    items = fx.embedding_items(spark, SF_SMALL)
    classes = summaries.class_vectors(items)
    q = classes.filter(F.col("class_id") == 3).select("vec")
    src = tempfile.mkdtemp(prefix="shiftlab-stream-")
    items.select("item_id", "features").repartition(4, "item_id").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("item_id long, features array<float>").option("maxFilesPerTrigger", 1).parquet(src)
    scored = scoring.contrastive_scores(stream, q.select(F.lit(0).alias("class_id"), "vec"))
    scored = scored.select("item_id", F.element_at("scores", 1).alias("similarity"))
    state = os.path.join(src, "_state")
    got = streaming_top_n(scored, 7, state_path=state)
    want = retrieval.top_n(items, q, n=7)
    assert sorted(r.item_id for r in got.collect()) == sorted(r.item_id for r in want.collect())
    # at least 4 micro-batches ran, and only two state slots exist
    assert sorted(d for d in os.listdir(state) if d.startswith("slot=")) == ["slot=0", "slot=1"]
    import glob
    ids = {r.batch_id for p in glob.glob(os.path.join(state, "slot=*")) for r in spark.read.parquet(p).collect()}
    assert max(ids) >= 3


def test_streaming_confusion_equals_batch(spark):
    preds = fx.order_predictions(spark, SF_SMALL).select("run", "split", "item_id", "y_true", "y_pred", "domain")
    src = tempfile.mkdtemp(prefix="shiftlab-stream-")
    preds.repartition(3).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = streaming_confusion(stream, ["run", "split", "domain"])
    want = metrics.confusion(preds, ["run", "split", "domain"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_registered_streams_read_folders_of_part_files(spark, tmp_path):
    from shiftlab.registry import QUERIES
    from shiftlab.sources.tables import read_table
    for t in ("embeddings", "orders", "customer", "nation"):
        n = 4 if t in ("embeddings", "orders") else 1
        read_table(spark, SF_SMALL, t).repartition(n).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("streaming_top_n", "streaming_confusion", "streaming_report"):
        key = lambda r: str(r)
        parts = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=key)
        whole = sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()), key=key)
        assert parts == whole and parts


def test_an_endless_stream_returns_its_handle(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(10).select(F.col("id").alias("item_id"), (F.col("id") / 10).alias("similarity"))
    rows.write.parquet(src)
    q = streaming_top_n(spark.readStream.schema(rows.schema).parquet(src), 3, state_path=out, available_now=False)
    try:
        q.processAllAvailable()
        from shiftlab.streaming.top_n import latest_state
        assert sorted(r.item_id for r in latest_state(spark, out).collect()) == [7, 8, 9]
    finally:
        q.stop()


def _probs(n, seed):
    import numpy as np
    r = np.random.default_rng(seed)
    rows = [(int(i), int(r.integers(0, 4)), [float(round(v, 1)) for v in r.random(4)]) for i in r.permutation(n)]
    return rows + [(n + 1, 1, [0.5, float("nan"), 0.1, 0.1]), (n + 2, 0, None)]


def test_streaming_top_k_equals_batch_over_batches_and_a_restart(spark):
    """Ties, NaN and NULL vectors; four batches, then more files with the same checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    src, checkpoint = tempfile.mkdtemp(prefix="shiftlab-stream-"), tempfile.mkdtemp(prefix="shiftlab-ck-")
    schema = "item_id long, y_true int, probs array<double>"
    first, more = spark.createDataFrame(_probs(200, 1), schema), spark.createDataFrame(
        [(i + 1000, y, p) for i, y, p in _probs(100, 2)], schema)
    first.repartition(4).write.mode("append").parquet(src)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    def same(got, df):
        want = retrieval.top_k_per_class(df, 9)
        cols = ["class_id", "rank", "item_id", "y_true"]
        assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())
        recall = {r.class_id: r.recall for r in streaming_recall_at_k(got, 9, 6).collect()}
        assert recall == {r.class_id: r.recall for r in retrieval.recall_at_k_per_class(df, 9, 6).collect()}

    same(streaming_top_k(stream(), 9, checkpoint=checkpoint), first)
    assert len(os.listdir(os.path.join(checkpoint, "commits"))) >= 4
    more.repartition(3).write.mode("append").parquet(src)
    same(streaming_top_k(stream(), 9, checkpoint=checkpoint), first.unionByName(more))
    same(streaming_top_k(stream(), 9, checkpoint=checkpoint), first.unionByName(more))     # nothing new
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_streaming_top_k_sends_k_rows_per_task_and_class(spark):
    src = tempfile.mkdtemp(prefix="shiftlab-stream-")
    schema = "item_id string, y_true int, probs array<double>"
    df = spark.createDataFrame([(f"i{i:04d}", i % 2, [i / 500, 0.5]) for i in range(500)], schema)
    df.coalesce(1).write.mode("append").parquet(src)
    q = start_top_k(spark.readStream.schema(schema).parquet(src), 3, os.path.join(src, "_ck"))
    q.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[:1]) == 2      # a value per class
    got = {(r.class_id, r.rank): r.item_id for r in top_k_so_far(spark, os.path.join(src, "_ck")).collect()}
    assert got == {(0, 1): "i0499", (0, 2): "i0498", (0, 3): "i0497", (1, 1): "i0000", (1, 2): "i0001", (1, 3): "i0002"}
