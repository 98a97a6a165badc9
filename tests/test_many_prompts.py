"""T1 for many prompts: exact against one prompt at a time, and what the bounds spare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlab.operators import many_prompts, retrieval


def _tables(spark, n=3000, d=24, p=6, seed=0, spread=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (r.pareto(2.0, size=(n, 1)) + 0.05 if spread else 1)
    x *= 1.0 if spread else 0.6 ** np.arange(d)                # as after a rotation to principal axes
    x[10] = x[11] = x[12]                                      # ties go to the smaller key
    x[20] = 0.0
    rows = [(int(i), [float(v) for v in x[i]]) for i in r.permutation(n)] + [(n + 1, None)]
    items = spark.createDataFrame(rows, "item_id long, features array<double>").repartition(3)
    q = np.vstack([r.normal(size=(p - 1, d)), x[11]])
    prompts = spark.createDataFrame([(i, [float(v) for v in q[i]]) for i in range(p)], "class_id int, vec array<double>")
    return items, prompts, x, q


def test_equals_one_prompt_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(many_prompts, "BLOCK_ROWS", 200)
    items, prompts, _, _ = _tables(spark)
    hits, spared = many_prompts.top_n_many(items, prompts, n=7)
    got = hits.collect()
    for p in range(6):
        one = retrieval.top_n(items.filter("item_id <> 20"), prompts.filter(F.col("class_id") == p).select("vec"), n=7)
        want = [(r.item_id, round(r.similarity, 8)) for r in one.orderBy("rank").collect()]
        assert [(r.item_id, round(r.similarity, 8)) for r in sorted((g for g in got if g.prompt_id == p), key=lambda g: g.rank)] == want
    s = spared.first()
    assert s.pairs == 6 * 2999 and s.finished < s.pairs / 2


def test_norms_end_blocks_early(spark, monkeypatch):
    monkeypatch.setattr(many_prompts, "BLOCK_ROWS", 200)
    items, prompts, x, q = _tables(spark, seed=1, spread=True)
    hits, spared = many_prompts.top_n_many(items, prompts, n=5, scale=2.0, normalize=False)
    sims = x @ q.T * 2.0
    for p in range(6):
        want = sorted(range(len(x)), key=lambda i: (-round(sims[i, p], 9), i))[:5]
        assert [r.item_id for r in hits.where(F.col("prompt_id") == p).orderBy("rank").collect()] == want
    s = spared.first()
    assert s.blocks >= 6 * 15 and s.ended_early > s.blocks / 2 and s.finished < s.pairs / 10


def test_few_items_and_string_keys(spark):
    items = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0])], "item_id string, features array<double>")
    prompts = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_id int, vec array<double>")
    hits, _ = many_prompts.top_n_many(items, prompts, n=5)
    got = [(r.prompt_id, r.rank, r.item_id, round(r.similarity, 6)) for r in hits.orderBy("prompt_id", "rank").collect()]
    assert got == [(0, 1, "a", 100.0), (0, 2, "b", 100.0), (0, 3, "c", 0.0), (1, 1, "c", 100.0), (1, 2, "a", 0.0), (1, 3, "b", 0.0)]
    assert many_prompts.top_n_many(items.limit(0), prompts, n=5)[0].count() == 0
    with pytest.raises(ValueError):
        many_prompts.top_n_many(items, prompts, n=0)
