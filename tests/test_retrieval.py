import numpy as np
from pyspark.sql import functions as F

from shiftlab.operators import retrieval


def _probs(spark, rows):
    return spark.createDataFrame(rows, "item_id long, y_true int, probs array<double>")


def test_top_k_per_class_ties_and_small_n(spark):
    p = _probs(spark, [(3, 0, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 0, [0.9, 0.1])])
    top = retrieval.top_k_per_class(p, k=5).orderBy("class_id", "rank").collect()
    assert [(r.class_id, r.item_id) for r in top] == [(0, 2), (0, 1), (0, 3), (1, 1), (1, 3), (1, 2)]


def test_recall_divides_by_k_and_counts_empty_classes(spark):
    p = _probs(spark, [(1, 0, [0.9, 0.1, 0.0]), (2, 0, [0.8, 0.2, 0.0]), (3, 1, [0.1, 0.9, 0.0])])
    per = {r.class_id: r.recall for r in retrieval.recall_at_k_per_class(p, k=4, n_classes=3).collect()}
    # class 0: top-4 = all 3 rows, 2 with label 0 -> 2/4; class 2 has no true rows -> 0
    assert per == {0: 0.5, 1: 0.25, 2: 0.0}
    assert abs(retrieval.recall_at_k(p, 4, 3).first().recall_at_k - 0.25) < 1e-12


def test_recall_by_run_equals_single(spark):
    p = _probs(spark, [(1, 0, [0.9, 0.1]), (2, 1, [0.2, 0.8]), (3, 1, [0.6, 0.4])])
    single = retrieval.recall_at_k(p, 2, 2).first().recall_at_k
    both = retrieval.recall_at_k(p.withColumn("run", F.lit(0)), 2, 2, by=["run"]).first().recall_at_k
    assert abs(single - both) < 1e-12


def test_plans_keep_topk_bounded(spark):
    p = _probs(spark, [(i, i % 2, [i / 10.0, 1 - i / 10.0]) for i in range(10)])
    plan = retrieval.top_k_per_class(p, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "item_id long, features array<float>")
    q = spark.createDataFrame([([0.0, 1.0],)], "vec array<double>")
    t = retrieval.top_n(items, q, n=3)
    assert "TakeOrderedAndProject" in t._jdf.queryExecution().executedPlan().toString()
    assert [r.item_id for r in t.orderBy("rank").collect()] == [9, 8, 7]


def test_top_n_fewer_items_than_n(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "item_id long, features array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "vec array<double>")
    rows = retrieval.top_n(items, q, n=5).orderBy("rank").collect()
    assert [r.item_id for r in rows] == [1, 2]                          # tie: smaller id first


def test_attach_labels_keys_on_id(spark):
    hits = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "item_id long, similarity double, rank int")
    items = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "item_id long, y_true int")
    classes = spark.createDataFrame([(0, "unknown bird"), (1, "unknown bird")], "class_id int, class_name string")
    got = {r.item_id: (r.y_true, r.class_name) for r in retrieval.attach_labels(hits, items, classes).collect()}
    assert got == {1: (0, "unknown bird"), 2: (1, "unknown bird")}


def test_top_k_sends_few_rows_and_touches_no_setting(spark):
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 4)), [float(x) for x in r.random(4)]) for i in range(3000)]
    rows += [(5000, 1, [0.5, float("nan"), 0.1, 0.1]), (5001, 0, None)]
    probs = spark.createDataFrame(rows, "item_id long, y_true int, probs array<double>").repartition(6)
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", None)
    for k in (3, 2500):
        top = retrieval.top_k_per_class(probs, k)
        plan = top._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.rindex("REPARTITION_BY_COL"):]
        assert "Sort" not in below and "Generate" not in below and "MapInPandas" in below
        got = {}
        for x in top.collect():
            got.setdefault(x.class_id, []).append((x.rank, x.item_id))
        for c in range(4):
            want = sorted((x for x in rows if x[2] is not None),
                          key=lambda x: (-(np.inf if np.isnan(x[2][c]) else round(x[2][c], 12)), x[0]))[:k]
            assert sorted(got[c]) == [(i + 1, x[0]) for i, x in enumerate(want)]
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", None) == before
