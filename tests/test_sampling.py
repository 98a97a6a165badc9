import pytest
from pyspark.sql import functions as F

from shiftlab.operators import sampling


def _items(spark, n, split="train"):
    return spark.createDataFrame([(split, i, i % 3, i % 4) for i in range(n)],
                                 "split string, item_id long, y_true int, domain int")


def test_with_index_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k int, item_id long")
    out = sampling.with_index(df, ["k", "item_id"], n_buckets=5).collect()
    ref = sorted((r.k, r.item_id) for r in out)
    got = sorted(out, key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(500))
    assert [(r.k, r.item_id) for r in got] == ref


def test_with_index_hot_key_is_split(spark):
    # one key holds most of the rows: the range bounds still split it by the tie-break column
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k int, item_id long")
    idx = sampling.with_index(df, ["k", "item_id"], n_buckets=6)
    assert idx.count() == 3000 and idx.select("idx").distinct().count() == 3000


@pytest.mark.parametrize("frac,expect", [(-0.1, 0), (0.0, 0), (0.5, 4), (1.0, 9), (1.7, 9)])
def test_subset_fraction_sizes(spark, frac, expect):
    items = _items(spark, 9).unionByName(_items(spark, 3, "test").withColumn("item_id", F.col("item_id") + 100))
    out = sampling.subset_fraction(items, frac, seed=1)
    assert out.filter(F.col("split") == "train").count() == expect     # 4.5 rounds to even
    assert out.filter(F.col("split") == "test").count() == 3           # other splits untouched


def test_subset_fraction_is_nested(spark):
    items = _items(spark, 200)
    small = {r.item_id for r in sampling.subset_fraction(items, 0.05, seed=3).collect()}
    big = {r.item_id for r in sampling.subset_fraction(items, 0.10, seed=3).collect()}
    assert len(small) == 10 and len(big) == 20 and small <= big


def test_shard_padding_rules(spark):
    one = sampling.shard(_items(spark, 1), world=4).collect()
    assert sorted((r.position, r.shard) for r in one) == [(0, 0), (1, 1)]   # shards 2, 3 empty
    ten = sampling.shard(_items(spark, 10), world=4).collect()
    sizes = [sum(1 for r in ten if r.shard == s) for s in range(4)]
    assert sizes == [3, 3, 3, 3]
    assert sorted(r.item_id for r in ten if r.position >= 10) == [0, 1]
    nopad = sampling.shard(_items(spark, 10), world=4, pad=False).count()
    assert nopad == 10
    assert sampling.shard(_items(spark, 10), world=4, rank=1).count() == 3
    with pytest.raises(ValueError):
        sampling.shard(_items(spark, 10), world=4, rank=4)


def test_batches(spark):
    out = {r.item_id: r.batch for r in sampling.batches(_items(spark, 5), 2).collect()}
    assert out == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_group_weights_sum_to_one_per_group(spark):
    w = sampling.group_weights(_items(spark, 10))
    per = {r.domain: r.s for r in w.groupBy("domain").agg(F.sum("weight").alias("s")).collect()}
    assert all(abs(v - 0.25) < 1e-12 for v in per.values())
    assert abs(sum(per.values()) - 1.0) < 1e-12


def test_group_balanced_sample_uniform_over_groups(spark):
    # group 0 holds most rows; draws are still spread evenly over the 4 groups
    rows = [("train", i, 0, 0 if i < 700 else 1 + i % 3) for i in range(1000)]
    items = spark.createDataFrame(rows, "split string, item_id long, y_true int, domain int")
    s = sampling.group_balanced_sample(items, n=4000, seed=5)
    counts = {r.domain: r["count"] for r in s.groupBy("domain").count().collect()}
    assert s.count() == 4000 and len(counts) == 4
    assert all(abs(c - 1000) < 150 for c in counts.values())
    again = sampling.group_balanced_sample(items, n=4000, seed=5)
    assert sorted((r.draw, r.item_id) for r in s.collect()) == sorted((r.draw, r.item_id) for r in again.collect())


def test_group_ids_mixed_radix(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (5, "a"), (5, "b")], "hospital int, region string")
    got = {(r.hospital, r.region): r.group_id for r in sampling.group_ids(df, ["hospital", "region"]).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (5, "a"): 2, (5, "b"): 3}


def test_domain_filter_only_train(spark):
    items = _items(spark, 8).unionByName(_items(spark, 4, "test"))
    out = sampling.domain_filter(items, 0)
    assert out.filter(F.col("split") == "train").select("domain").distinct().collect()[0].domain == 0
    assert out.filter(F.col("split") == "test").count() == 4


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_with_index_is_the_same_for_any_number_of_ranges(spark, ranges):
    df = spark.createDataFrame([(i * 7 % 101, f"t{i}", i) for i in range(300)] + [(None, "n", 999)],
                               "k long, payload string, item_id long")
    out = sampling.with_index(df, ["k", "item_id"], n_buckets=ranges).collect()
    ref = sorted(out, key=lambda r: (r.k is not None, r.k if r.k is not None else 0, r.item_id))
    assert [r.idx for r in ref] == list(range(301))           # NULL key first, then ascending


def _nullable(spark, n=20):
    return spark.createDataFrame([("train" if i % 5 else None, i, i % 3, i % 4 or None) for i in range(n)],
                                 "split string, item_id long, y_true int, domain int")


def test_null_groups_keep_their_rows_and_draws(spark):
    items = _nullable(spark)
    w = sampling.group_weights(items).collect()
    assert len(w) == 20 and all(abs(r.weight - 1 / (4 * r.group_n)) < 1e-12 for r in w)
    draws = sampling.group_balanced_sample(items, n=400, seed=2)
    assert draws.count() == 400 and draws.columns[:4] == items.columns
    share = draws.filter(F.col("domain").isNull()).count()
    assert 60 < share < 140
    ids = sampling.group_ids(items, ["domain", "y_true"]).collect()
    assert len(ids) == 20 and {r.group_id for r in ids if r.domain is None} <= {0, 1, 2}


def test_null_splits_are_among_the_others(spark):
    items = _nullable(spark)
    assert sampling.subset_fraction(items, 1.0).count() == 20
    assert sampling.subset_fraction(items, 0.0).count() == 4
    assert sampling.subset_fraction(items, 0.5).count() == 4 + 8


def test_subset_is_the_smallest_hashes_and_one_scan(spark):
    items = _items(spark, 500)
    got = {r.item_id for r in sampling.subset_fraction(items, 0.3, seed=9).collect()}
    import hashlib
    h = sorted(range(500), key=lambda i: (int(hashlib.md5(f"{i}:9".encode()).hexdigest()[:15], 16), i))
    assert got == set(h[:150])


def test_index_evaluates_a_computed_column_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x * 2
    df = spark.range(1000).select("id", counted.asNondeterministic()("id").alias("twice"))
    assert sampling.with_index(df, "id", n_buckets=8).agg(F.sum("twice")).first()[0] == 999_000
    assert calls.value == 1000


def test_index_writes_no_checkpoint(spark, tmp_path):
    plan = sampling.with_index(_items(spark, 200), ["domain", "item_id"], n_buckets=4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Window" in text
    assert sorted(r.idx for r in plan.collect()) == list(range(200))


def test_domain_filter_keeps_rows_without_a_split(spark):
    items = spark.createDataFrame([(None, 1), ("train", 0), ("train", 1), ("train", None), ("val", 1)], "split string, domain int")
    kept = [tuple(r) for r in sampling.domain_filter(items, 0).collect()]
    assert sorted(kept, key=repr) == sorted([(None, 1), ("train", 0), ("val", 1)], key=repr)
