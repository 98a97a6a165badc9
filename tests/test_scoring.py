from pyspark.sql import functions as F
import numpy as np
import pytest

from shiftlab.operators import scoring, summaries
from shiftlab.sources import fixtures as fx
from conftest import SF_SMALL


def _items_classes(spark):
    items = fx.embedding_items(spark, SF_SMALL)
    return items, summaries.class_vectors(items)


def test_arrow_path_equals_native_path(spark):
    items, classes = _items_classes(spark)
    a = scoring.contrastive_scores(items.select("item_id", "features"), classes).orderBy("item_id").collect()
    b = scoring.contrastive_scores_native(items.select("item_id", "features"), classes) \
               .orderBy("item_id").collect()
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert np.allclose(x.scores, y.scores, atol=1e-9)


def test_scores_match_numpy(spark):
    items, classes = _items_classes(spark)
    W, _ = scoring.collect_class_matrix(classes)
    rows = scoring.contrastive_scores(items.select("item_id", "features"), classes).orderBy("item_id").collect()
    X = np.array([r.features for r in items.orderBy("item_id").collect()], dtype=np.float64)
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    Wn = W / np.linalg.norm(W, axis=1, keepdims=True)
    assert np.allclose(np.array([r.scores for r in rows]), 100.0 * Xn @ Wn.T, atol=1e-9)


def test_linear_scores_with_bias(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "item_id long, features array<float>")
    head = spark.createDataFrame([(0, [1.0, 0.0], 0.5), (1, [0.0, 1.0], -1.0)],
                                 "class_id int, w array<double>, b double")
    out = {r.item_id: r.scores for r in scoring.linear_scores(df, head).collect()}
    assert out[1] == [1.5, 1.0]
    assert out[2] is None                      # NULL vectors stay NULL


def test_class_ids_must_be_dense(spark):
    head = spark.createDataFrame([(0, [1.0]), (2, [1.0])], "class_id int, vec array<double>")
    with pytest.raises(ValueError):
        scoring.collect_class_matrix(head)


def test_size_bound_and_blocked_long_form(spark):
    items, classes = _items_classes(spark)
    with pytest.raises(scoring.ClassMatrixTooLarge):
        scoring.contrastive_scores(items, classes, max_bytes=1000)
    direct = scoring.score_pairs(items, classes).orderBy("item_id", "class_id").collect()
    blocked = scoring.score_pairs_blocked(items, classes).orderBy("item_id", "class_id").collect()
    assert len(direct) == len(blocked)
    assert all(a.item_id == b.item_id and a.class_id == b.class_id and abs(a.score - b.score) < 1e-9
               for a, b in zip(direct, blocked))


def test_single_udf_evaluation_in_long_form(spark):
    items, classes = _items_classes(spark)
    plan = scoring.score_pairs(items, classes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_predict_table_probabilities(spark):
    items, classes = _items_classes(spark)
    rows = scoring.predict_table(items, classes).collect()
    assert all(abs(sum(r.probs) - 1.0) < 1e-9 for r in rows)


def test_blocked_product_with_many_cells(spark):
    items, classes = _items_classes(spark)
    blocked = scoring.score_pairs_blocked(items, classes, cell_pairs=16)      # 4 x 4 cells
    direct = {(r.item_id, r.class_id): r.score for r in scoring.score_pairs(items, classes).collect()}
    got = {(r.item_id, r.class_id): r.score for r in blocked.collect()}
    assert got.keys() == direct.keys()
    assert all(abs(got[k] - direct[k]) < 1e-9 for k in direct)


def test_zero_vector_scores_are_nan(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "item_id long, features array<float>")
    classes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_id int, vec array<double>")
    out = {r.item_id: r.scores for r in scoring.contrastive_scores(items, classes).collect()}
    assert all(np.isnan(x) for x in out[1])           # 0/0, as the normalised product gives
    assert out[2] == [100.0, 0.0]


def test_predict_table_ordered(spark):
    items, classes = _items_classes(spark)
    df, n = scoring.predict_table_ordered(items, classes)
    rows = df.orderBy("idx").collect()
    assert n == items.count() == len(rows)
    assert [r.idx for r in rows] == list(range(n))
    assert [r.item_id for r in rows] == sorted(r.item_id for r in rows)


def test_null_vectors_are_treated_alike(spark):
    from shiftlab.operators import inference
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], "item_id long, features array<float>")
    classes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_id int, vec array<double>")
    direct = {(r.item_id, r.class_id, r.score) for r in scoring.score_pairs(items, classes).collect()}
    blocked = {(r.item_id, r.class_id, r.score) for r in scoring.score_pairs_blocked(items, classes).collect()}
    assert direct == blocked and {d[0] for d in direct} == {1, 3}
    out = inference.infer(items, inference.linear_model_factory(np.eye(2)), width=2).collect()
    assert {r.item_id: r.scores for r in out} == {1: [1.0, 0.0], 2: None, 3: [0.0, 2.0]}
    text = spark.createDataFrame([("a b a",), (None,)], "prompt string")
    vec = [r.vec for r in inference.encode_text(text, inference.hashed_words_factory(8)).collect()]
    assert sum(vec[0]) == 3 and max(vec[0]) >= 2 and vec[1] is None


def test_vector_mean_with_many_keys_and_null_keys(spark):
    from shiftlab.operators import summaries
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v")) \
        .withColumn("k", F.expr("nullif(k, 5)")).repartition(5)
    got = {r.k: r.mean for r in summaries.vector_mean(df, ["k"]).collect()}
    ids = {k: [i for i in range(3000) if i % 700 == k] for k in range(700)}
    assert len(got) == 700 and all(abs(got[None if k == 5 else k][0] - sum(v) / len(v)) < 1e-9 for k, v in ids.items())


def test_class_sides_beyond_the_bound_give_the_same_rows(spark, monkeypatch):
    """With a bound of 1 KB the classes come from storage in many blocks: array and long form, P2, P3 and P6."""
    from shiftlab.operators import class_blocks
    r = np.random.default_rng(5)
    items = spark.createDataFrame([(i, int(r.integers(0, 50)), [float(v) for v in r.normal(size=16)] if i % 9 else None)
                                   for i in range(60)], "item_id long, y_true int, features array<float>").repartition(3)
    head = spark.createDataFrame([(c, [float(v) for v in r.normal(size=16)], float(c) / 10) for c in range(50)],
                                 "class_id int, vec array<double>, b double").repartition(4)
    monkeypatch.setattr(class_blocks, "ROW_BYTES", 2000)                # five items at a time
    for kw in ({}, {"normalize": False, "scale": 2.0}, {"normalize": False, "scale": 1.0, "bias_col": "b"}):
        want = {x.item_id: x.scores for x in class_blocks.class_scores(items, head, **kw).collect()}
        got = {x.item_id: x.scores for x in class_blocks.class_scores(items, head, max_bytes=1024, **kw).collect()}
        assert got.keys() == want.keys() and got[9] is None
        assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want if want[i] is not None)
    long = {(x.item_id, x.class_id): x.score for x in scoring.score_pairs(items, head).collect()}
    far = {(x.item_id, x.class_id): x.score for x in scoring.score_pairs(items, head, max_bytes=1024).collect()}
    assert far.keys() == long.keys() and all(abs(far[k] - long[k]) < 1e-9 for k in long)
    side = head.select("class_id", F.col("vec").alias("w"), "b")
    for one, two in ((scoring.predict_table(items, head), scoring.predict_table(items, head, max_bytes=1024)),
                     (scoring.predict_table(items, head=side), scoring.predict_table(items, head=side, max_bytes=1024))):
        want = {x.item_id: x.probs for x in one.collect()}
        assert all(np.allclose(x.probs, want[x.item_id]) for x in two.collect() if x.probs is not None)
    with pytest.raises(ValueError):
        class_blocks.class_scores(items, head.filter("class_id <> 3"), max_bytes=1024)
