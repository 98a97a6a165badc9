import math

import numpy as np
from pyspark.sql import functions as F

from shiftlab.functions import vectors as V


def _one(spark, expr, data, schema="v array<double>"):
    return spark.createDataFrame(data, schema).select(expr.alias("r")).collect()


def test_l2_normalize_unit_zero_and_width_one(spark):
    rows = _one(spark, V.l2_normalize("v"), [([3.0, 4.0],), ([0.0, 0.0],), ([2.0],)])
    assert rows[0].r == [0.6, 0.8]
    assert rows[1].r == [None, None]          # zero vector: NULL elements (ANSI-safe)
    assert rows[2].r == [1.0]


def test_softmax_sums_to_one_and_is_shift_stable(spark):
    rows = _one(spark, V.softmax("v"), [([100.0, -100.0, 100.0],), ([1.0, 2.0, 3.0],)])
    for r in rows:
        assert math.isclose(sum(r.r), 1.0, rel_tol=1e-12)
    assert math.isclose(rows[0].r[0], 0.5) and rows[0].r[1] < 1e-80
    e = np.exp([1.0, 2.0, 3.0])
    assert np.allclose(rows[1].r, e / e.sum())


def test_argmax_first_wins_ties(spark):
    rows = _one(spark, V.argmax_class("v"), [([1.0, 5.0, 2.0, 5.0],), ([-1.0],)])
    assert [r.r for r in rows] == [1, 0]


def test_cross_entropy_matches_numpy(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], 0)], "v array<double>, y int") \
                .select(V.cross_entropy("v", "y").alias("ce")).collect()
    s = np.array([1.0, 2.0, 3.0])
    assert math.isclose(rows[0].ce, np.log(np.exp(s).sum()) - s[0], rel_tol=1e-12)


def test_standardize_channels(spark):
    px = [0.5, 0.5, 0.5, 1.0, 1.0, 1.0]
    rows = _one(spark, V.standardize("v", V.IMAGENET_MEAN, V.IMAGENET_STD), [(px,)])
    exp = [(x - V.IMAGENET_MEAN[i % 3]) / V.IMAGENET_STD[i % 3] for i, x in enumerate(px)]
    assert np.allclose(rows[0].r, exp)


def test_explode_vector_keeps_positions(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [])], "k int, v array<double>")
    out = V.explode_vector(df, "k", "v").orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.value) for r in out] == [(1, 0, 0.1), (1, 1, 0.2)]


def test_softmax_and_norm_grow_about_linearly_with_the_width(spark):
    import time

    def seconds(width, rows):
        data = spark.range(rows).select(F.transform(F.sequence(F.lit(1), F.lit(width)),
                                                    lambda i: F.sin(i * F.col("id") + i)).alias("v"))
        best = math.inf
        for _ in range(3):
            t = time.perf_counter()
            data.select(V.softmax("v").alias("p"), V.l2_normalize("v").alias("n")) \
                .write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        return best
    # as many numbers in both: the wide rows may cost little more
    assert seconds(720, 3_000) < 4 * seconds(60, 36_000)


def test_let_computes_once_and_passes_null(spark):
    rows = _one(spark, V.softmax("v"), [(None,), ([0.0],)])
    assert rows[0].r is None and rows[1].r == [1.0]
    assert _one(spark, V.argmax_class("v"), [(None,)])[0].r is None
    assert _one(spark, V.log_sum_exp("v"), [([0.0, 0.0],)])[0].r == math.log(2)
