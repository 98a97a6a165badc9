from pyspark.sql import functions as F

from shiftlab.plans import probe
from shiftlab.sources import fixtures as fx
from conftest import SF_SMALL


def _separable(spark):
    rows = []
    for i in range(120):
        c = i % 3
        v = [0.0, 0.0, 0.0]
        v[c] = 1.0 + (i % 7) / 10.0
        split = "train" if i < 90 else ("id_test" if i < 105 else "test")
        rows.append((split, i, v, c, i % 2))
    return spark.createDataFrame(rows, "split string, item_id long, features array<float>, y_true int, domain int")


def test_linear_probe_learns_a_separable_problem(spark):
    items = _separable(spark)
    head = probe.fit_linear_probe(items.filter(F.col("split") == "train"), n_classes=3)
    assert head.count() == 3 and len(head.first().w) == 3
    acc = {r.split: r.acc_avg for r in probe.probe_report(items, n_classes=3).collect()}
    assert acc["id_test"] == 1.0 and acc["test"] == 1.0


def test_learning_curve_rows_and_more_data_helps(spark):
    items = fx.document_items(spark, SF_SMALL)
    curve = probe.learning_curve(items, [0.1, 1.0], [1e-3], runs=2).collect()
    assert {(r.perc, r.split) for r in curve} == {(0.1, "ID Test"), (0.1, "OOD Test"), (1.0, "ID Test"), (1.0, "OOD Test")}
    by = {(r.perc, r.split): r.value for r in curve}
    assert by[(1.0, "OOD Test")] >= by[(0.1, "OOD Test")]


def test_learning_curve_zero_shot_point(spark):
    items = _separable(spark)
    zero = probe.untrained_head(spark, 3, 3)
    curve = probe.learning_curve(items, [1.0], [1e-3], runs=1, zero_shot_head=zero).collect()
    by = {(r.perc, r.split): r.value for r in curve}
    assert set(by) == {(0.0, "ID Test"), (0.0, "OOD Test"), (1.0, "ID Test"), (1.0, "OOD Test")}
    # the untrained head predicts class 0 for every item
    assert by[(0.0, "ID Test")] < by[(1.0, "ID Test")] == 1.0
