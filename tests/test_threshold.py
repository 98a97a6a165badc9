"""Large k per class: thresholds by bits, few rows moved, ties by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlab.operators import retrieval, threshold

NAN = float("nan")


def _table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"run int, item_id {kind}, y_true int, probs array<double>").repartition(5)


def _want(rows, k):
    out = []
    for run in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == run and r[3] is not None]
        for c in range(len(own[0][3]) if own else 0):
            def value(r):
                return -np.inf if np.isnan(r[3][c]) else -round(r[3][c], 12)
            for n, r in enumerate(sorted(own, key=lambda r: (value(r), r[1]))[:k], 1):
                out.append((run, c, n, r[1], r[2]))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.run, r.class_id, r.rank, r.item_id, r.y_true) for r in df.collect()), key=repr)


def test_order_is_kept():
    v = np.array([-np.inf, -2.5, -1e-13, 0.0, 1e-9, 0.3, 1.0, np.inf])
    u = threshold.ordered(v)
    assert (np.diff(u.astype(object)) >= 0).all() and u[2] == u[3] and threshold.ordered(np.array([NAN]))[0] == u[-1]


@pytest.mark.parametrize("k, slack", [(1, 0), (7, 0), (40, 0), (40, 3), (150, 0), (500, 0)])
def test_selection_equals_sorting(spark, monkeypatch, k, slack):
    """Random values, many ties, NaN, NULL vectors, negative keys, a NULL run, k beyond the rows."""
    monkeypatch.setattr(threshold, "SLACK", slack)
    r = np.random.default_rng(k)
    rows = [(None if i % 3 == 0 else 1, int(k_), int(r.integers(0, 3)),
             None if i % 50 == 0 else [float(r.random()), float(r.integers(0, 3)) / 7, NAN if i % 11 == 0 else 0.5])
            for i, k_ in enumerate(r.permutation(400) - 200)]
    assert _got(threshold.select_per_class(_table(spark, rows), k, ["run"])) == _want(rows, k)


def test_only_rows_that_reach_the_threshold_move(spark, monkeypatch):
    monkeypatch.setattr(threshold, "SLACK", 5)
    r = np.random.default_rng(1)
    n, k = 3000, 200
    rows = [(1, i, 0, [float(r.random()), 0.25, float(i % 2)]) for i in range(n)]
    df = _table(spark, rows)
    moved = threshold.rows_reaching(df, threshold.find_thresholds(df, k, ["run"]), ["run"])
    per_class = {c: m for c, m in moved.groupBy("class_id").count().collect()}
    assert set(per_class) == {0, 1, 2} and all(k <= m <= k + 5 for m in per_class.values())


def test_string_keys_move_their_ties(spark):
    rows = [(1, f"k{i:03d}", i % 2, [0.5, i / 100]) for i in range(100)]
    assert _got(threshold.select_per_class(_table(spark, rows, "string"), 10, ["run"])) == _want(rows, 10)


def test_top_k_uses_it_beyond_what_a_task_holds(spark, monkeypatch):
    rows = [(1, i, i % 3, [((i * 37) % 101) / 101, 0.5, 1 - i / 100]) for i in range(100)]
    df = _table(spark, rows).drop("run")
    want = {(r.class_id, r.rank, r.item_id) for r in retrieval.top_k_per_class(df, 30).collect()}
    recall = retrieval.recall_at_k(df, 30, 3).first()[0]
    calls = []
    find = threshold.find_thresholds
    monkeypatch.setattr(threshold, "find_thresholds", lambda *a: calls.append(1) or find(*a))
    monkeypatch.setattr(retrieval, "MAX_HELD", 20)
    assert {(r.class_id, r.rank, r.item_id) for r in retrieval.top_k_per_class(df, 30).collect()} == want
    assert retrieval.recall_at_k(df, 30, 3).first()[0] == recall and calls


def test_empty_table(spark):
    assert threshold.select_per_class(_table(spark, []), 5, ["run"]).filter(F.col("rank") > 0).collect() == []
