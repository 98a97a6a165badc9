"""The stacked solver, tree sums, subset cuts and training over epochs."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shiftlab.operators import sampling, summaries, tree
from shiftlab.plans import probe, solver, training


def _rows(n=400, d=6, c=3, seed=0):
    r = np.random.default_rng(seed)
    y = r.integers(0, c, n)
    x = r.normal(size=(n, d)) * np.arange(1, d + 1) + np.eye(c, d)[y] * 1.5 + 2.0
    x[:, d - 1] = 7.0                                        # a feature without spread
    return x.astype(np.float32), y


def _items(spark, x, y, split="train"):
    return spark.createDataFrame([(split, i, [float(v) for v in x[i]], int(y[i]), i % 3) for i in range(len(y))],
                                 "split string, item_id long, features array<float>, y_true int, domain int")


def _objective(x, y, w, b, reg):
    z = x.astype(np.float64) @ w.T + b
    z -= z.max(axis=1, keepdims=True)
    loss = np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])
    return loss + 0.5 * reg * ((w * x.astype(np.float64).std(axis=0, ddof=1)) ** 2).sum()


def test_heads_reach_the_objective_of_an_independent_solver(spark):
    x, y = _rows()
    items = _items(spark, x, y)
    data = items.select(array_to_vector(F.col("features").cast("array<double>")).alias("fv"),
                        F.col("y_true").cast("double").alias("label"))
    blocks = solver.feature_blocks(items, F.lit(1))
    for reg, mine in zip((1e-2, 1.0), solver.fit_heads(blocks, [(0, 1e-2), (0, 1.0)], 3, tolerance=1e-7)):
        other = LogisticRegression(featuresCol="fv", labelCol="label", family="multinomial", maxIter=300, tol=1e-10,
                                   regParam=reg, standardization=True).fit(data)
        w, b = other.coefficientMatrix.toArray(), other.interceptVector.toArray()
        assert _objective(x, y, mine.w, mine.b, reg) <= _objective(x, y, w, b, reg) + 1e-9
        assert np.abs((mine.w - mine.w.mean(axis=0)) - (w - w.mean(axis=0)))[:, :-1].max() < 1e-4
        assert (mine.w[:, -1] == 0).all()


def test_cells_share_scans_and_subsets_are_bits(spark, monkeypatch):
    """Eight cells over three subsets (one empty) take no more scans than the slowest of them."""
    x, y = _rows()
    y = np.where(np.arange(len(y)) < 50, y % 2, y)            # the first 50 rows lack a class
    blocks = solver.feature_blocks(_items(spark, x, y), F.when(F.col("item_id") < 50, 3).otherwise(1).cast("long"))
    calls = []
    scan = solver.loss_and_gradient
    monkeypatch.setattr(solver, "loss_and_gradient", lambda *a: calls.append(len(a[1])) or scan(*a))
    cells = [(s, reg) for s in (0, 1) for reg in (1e-3, 1e-2, 1e-1, 1.0)] + [(5, 1.0)]
    fitted = solver.fit_heads(blocks, cells, 4)
    assert fitted[-1] is None and all(f.gradient <= solver.GRADIENT for f in fitted[:-1])
    assert len(calls) == max(f.scans for f in fitted[:-1]) and calls[0] == 8 and calls[-1] < 8
    assert np.isinf(fitted[0].b[3]) and not np.isinf(fitted[0].b[:3]).any()
    assert np.isinf(fitted[4].b[2:]).all() and (fitted[4].w[2:] == 0).all()
    alone = solver.fit_heads(solver.feature_blocks(_items(spark, x[:50], y[:50]), F.lit(1)), [(0, 1e-2)], 4)[0]
    assert np.abs(alone.w - fitted[5].w).max() < 5e-2         # both within the gradient's tolerance


def test_heads_are_fitted_in_groups_of_bounded_size(spark, monkeypatch):
    x, y = _rows(n=100)
    blocks = solver.feature_blocks(_items(spark, x, y), F.lit(1))
    want = solver.fit_heads(blocks, [(0, 0.1), (0, 1.0)], 3)
    monkeypatch.setattr(solver, "STACK_BYTES", 1)
    got = solver.fit_heads(blocks, [(0, 0.1), (0, 1.0)], 3)
    assert all(np.allclose(a.w, b.w) for a, b in zip(want, got))
    with pytest.raises(RuntimeError):
        solver.fit_heads(blocks, [(0, 1e-3)], 3, max_steps=1)


def test_narrow_moments_only_change_the_way(spark, monkeypatch):
    x, y = _rows(n=200)
    blocks = solver.feature_blocks(_items(spark, x, y), F.lit(1))
    want = solver.fit_heads(blocks, [(0, 0.1)], 3, tolerance=1e-6)[0]
    monkeypatch.setattr(solver, "MOMENT_WIDTH", 2)
    got = solver.fit_heads(blocks, [(0, 0.1)], 3, tolerance=1e-6)[0]
    assert np.allclose(want.w, got.w, atol=1e-4)


def test_gradient_norm_of_a_fitted_head(spark):
    x, y = _rows(n=200)
    items = _items(spark, x, y)
    assert probe.gradient_norm(items, probe.fit_linear_probe(items, reg=1e-2), 1e-2) <= solver.GRADIENT * 1.01
    assert probe.gradient_norm(items, probe.untrained_head(spark, 3, 6), 1e-2) > 0.1


def test_blocks_keep_slices_and_leave_out_rows_without_vectors(spark):
    x, y = _rows(n=30)
    items = _items(spark, x, y).withColumn("split", F.when(F.col("item_id") < 10, "a").when(F.col("item_id") < 20, "b"))
    items = items.withColumn("features", F.when(F.col("item_id") != 3, F.col("features")))
    blocks = solver.feature_blocks(items, F.lit(1))
    assert {r.slice: r.n for r in blocks.groupBy("slice").agg(F.sum("n").alias("n")).collect()} == {"a": 9, "b": 10, None: 10}
    counts = solver.evaluate_heads(blocks, [(np.zeros((3, 6)), np.zeros(3))])
    assert {r.y_pred for r in counts.collect()} == {0}
    assert abs(sum(r.loss for r in counts.collect()) - 29 * math.log(3)) < 1e-9


def test_tree_sum_groups_are_bounded(spark, monkeypatch):
    """One key with a sum in each of 16 tasks: no group takes more than four of them."""
    groups = spark.sparkContext.accumulator(0)
    add = tree._add

    def counting(keys):
        inner = add(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = list(batches)
            if sum(b.num_rows for b in seen) > 4:
                raise ValueError("more than four partial sums")
            groups.add(1)
            yield from inner(iter(seen))
        return run
    monkeypatch.setattr(tree, "_add", counting)
    parts = spark.range(0, 16, 1, 16).select(F.lit("k").alias("k"), F.col("id").alias("_t"), F.array(
        F.col("id").cast("double"), F.lit(1.0)).alias("_s"), F.lit(1).cast("long").alias("_n"))
    row, = tree.tree_sum(parts, ["k"], fan=4).collect()
    assert (row.k, row._s, row._n) == ("k", [120.0, 16.0], 16)
    assert groups.value == 5                                 # four groups of four, then one of four
    with pytest.raises(Exception, match="more than four"):
        tree.tree_sum(parts, ["k"], fan=16).collect()


def test_vector_mean_of_one_key_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tree, "FAN", 2)
    df = spark.range(0, 100, 1, 9).select(F.lit(None).cast("string").alias("k"), F.array(F.col("id"), F.lit(3)).alias("v"))
    assert summaries.vector_mean(df, ["k"]).collect() == [(None, [49.5, 3.0])]
    assert summaries.vector_mean(df, []).collect() == [([49.5, 3.0],)]
    monkeypatch.setattr(summaries, "MAX_HELD_BYTES", 1)
    many = spark.range(200).select((F.col("id") % 50).alias("k"), F.array(F.col("id").cast("double")).alias("v"))
    assert {r.k: r.mean for r in summaries.vector_mean(many, ["k"]).collect()} == {k: [k + 75.0] for k in range(50)}


def test_subset_cuts_of_many_subsets(spark):
    items = spark.range(1000).select(F.when(F.col("id") % 5 > 0, "train").otherwise("val").alias("split"),
                                     F.col("id").alias("item_id"))
    cuts = sampling.subset_cuts(items, [0.0, 0.1, 0.25, 1.0], [0, 7])
    assert cuts[0, 0] == () and cuts[3, 1] is None
    for i, seed in enumerate([0, 7]):
        before = set()
        for f, frac in enumerate([0.0, 0.1, 0.25, 1.0]):
            kept = {r.item_id for r in items.filter("split = 'train'").filter(
                sampling.in_subset(items, cuts[f, i], seed)).collect()}
            assert len(kept) == round(800 * frac) and before <= kept
            assert kept == {r.item_id for r in sampling.subset_fraction(items, frac, seed).collect() if r.split == "train"}
            before = kept


def test_learning_rates():
    assert training.learning_rates(31, 1.0) == [1.0] * 15 + [0.1] * 15 + [pytest.approx(0.01)]
    rates = training.learning_rates(6, 1.0, swa_epochs=3, swa_lr=0.1)
    assert rates[:4] == [1.0] * 4 and rates[4] > rates[5] > 0.1
    assert training.learning_rates(8, 0.5, world=4) == pytest.approx([0.5, 0.8, 1.1, 1.4, 1.7, 2.0, 2.0, 2.0])


@pytest.mark.parametrize("optimizer, lr", [("adam", 0.05), ("sgd", 0.02)])
def test_training_over_epochs(spark, optimizer, lr):
    x, y = _rows(n=90)
    items = _items(spark, x, y).unionByName(_items(spark, x[:30], y[:30], "val").withColumn("item_id", F.col("item_id") + 500))
    items = items.unionByName(spark.createDataFrame([("train", 999, None, 1, 0)], items.schema))
    t = training.train_head(items, 3, n_epochs=5, batch_size=40, lr=lr, optimizer=optimizer, swa_epochs=2, eval_freq=2,
                            swa_lr=lr / 2)
    sizes = {(r.epoch, r.batch): r.n for r in t.batches.collect()}
    assert sizes == {(e, b): n for e in range(5) for b, n in enumerate([40, 40, 10])}
    batches = {(r.epoch, r.batch): r.loss for r in t.batches.collect()}
    losses = {r.epoch: r.loss for r in t.losses.collect()}
    assert batches[0, 0] == pytest.approx(math.log(3))        # a head of zeros
    assert all(losses[e] == pytest.approx(np.mean([batches[e, b] for b in range(3)])) for e in losses)
    assert [r.epoch for r in t.log.orderBy("epoch").collect()] == [0, 1, 3]
    heads = {(r.epoch, r.class_id): np.array(r.w + [r.b]) for r in t.heads.collect()}
    for r in t.averaged.collect():
        assert np.allclose(r.w + [r.b], (heads[3, r.class_id] + heads[4, r.class_id]) / 2)
    # the metric of an epoch is that of its head
    w, b = np.stack([heads[3, c][:-1] for c in range(3)]), np.array([heads[3, c][-1] for c in range(3)])
    right = ((x[:30].astype(np.float64) @ w.T + b).argmax(axis=1) == y[:30]).mean()
    assert {r.epoch: r.metric for r in t.log.collect()}[3] == pytest.approx(right)


def test_first_step_is_the_mean_gradient_of_the_drawn_rows(spark):
    x, y = _rows(n=60)
    items = _items(spark, x, y)
    t = training.train_head(items, 3, n_epochs=1, batch_size=60, lr=0.1, optimizer="sgd", eval_split="train")
    drawn = sampling.group_balanced_sample(items, 60, seed=1_000_003).collect()
    g = np.zeros((3, 7))
    for r in drawn:
        p = np.full(3, 1 / 3)
        p[r.y_true] -= 1
        g += np.outer(p, [*r.features, 1.0])
    for r in t.heads.collect():
        assert np.allclose(r.w + [r.b], -0.1 * g[r.class_id] / 60)


def test_a_step_is_one_job_without_a_shuffle(spark):
    x, y = _rows(n=400)
    items = _items(spark, x, y)
    jobs = {}
    for size in (10, 400):
        spark.sparkContext.setJobGroup(f"steps-{size}", "")
        t = training.train_head(items, 3, n_epochs=1, batch_size=size, lr=0.1, optimizer="sgd", eval_split="train")
        jobs[size] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{size}"))
        assert t.batches.count() == -(-400 // size)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[10] - jobs[400] <= 45                       # 39 steps more


def test_a_batch_of_several_partitions_has_the_sums_of_its_draws(spark, monkeypatch):
    monkeypatch.setattr(solver, "BLOCK_ROWS", 16)
    x, y = _rows(n=130)
    draws = _items(spark, x, y).withColumn("draw", F.col("item_id"))
    parts = solver.batch_parts(50, 21)
    assert parts == 4
    blocks = solver.batch_blocks(draws, 50, 3, parts)
    w, b = np.linspace(-1, 1, 18).reshape(3, 6), np.zeros(3)
    rows = {r.draw: r for r in draws.collect()}
    for batch in range(3):
        own = [rows[i] for i in range(130) if i // 50 == batch]
        want = solver._softmax_sums(np.array([r.features for r in own], np.float64), np.array([r.y_true for r in own]), w, b)
        assert np.allclose(solver.batch_sums(blocks, list(range(batch * parts, (batch + 1) * parts)), w, b), want)
    blocks.unpersist()


def test_training_refuses_what_it_cannot_do(spark):
    x, y = _rows(n=10)
    items = _items(spark, x, y)
    for bad in ({"batch_size": 0}, {"optimizer": "x"}, {"swa_epochs": 2}, {"group_id": 9}):
        with pytest.raises(ValueError):
            training.train_head(items, 3, **{"n_epochs": 2, "batch_size": 5, "lr": 0.1, **bad})
