"""Sanity anchors from FIXTURES.md (computed independently while surveying), at sf0.01."""

from pyspark.sql import functions as F

from shiftlab.operators import metrics, retrieval, summaries
from shiftlab.plans import zero_shot
from shiftlab.operators import scoring
from shiftlab.sources import fixtures as fx
from conftest import SF_MID


def test_zero_shot_accuracy_anchor(spark):
    items = fx.embedding_items(spark, SF_MID)
    preds = zero_shot.zero_shot_predictions(items, summaries.class_vectors(items))
    acc = {r.split: round(r.acc_avg, 4) for r in metrics.accuracy(preds, ["split"]).collect()}
    assert acc == {"train": 0.5512, "id_val": 0.1333, "id_test": 0.1, "val": 0.1613, "test": 0.1452}


def test_order_predictions_pooled_accuracy_anchor(spark):
    preds = fx.order_predictions(spark, SF_MID)
    acc = {r.split: round(r.acc_avg, 4) for r in metrics.accuracy(preds, ["split"]).collect()}
    assert acc == {"train": 0.6826, "id_val": 0.6933, "id_test": 0.6834, "val": 0.6866, "test": 0.681}


def test_recall_at_20_anchor(spark):
    items = fx.embedding_items(spark, SF_MID)
    probs = scoring.predict_table(items.filter(F.col("split") == "test"), summaries.class_vectors(items))
    assert round(retrieval.recall_at_k(probs, 20, 10).first().recall_at_k, 2) == 0.12
