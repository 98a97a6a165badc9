"""Reports through the data source, artifacts in storage, placed shards, bucketed predictions."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shiftlab.operators import experiments, sampling, scoring
from shiftlab.sources import artifacts, report_format, reports

LONG = "name string, metric string, split string, mean double, std double"


def _summary(spark, names, shift=0.0):
    rows = [(n, m, s, i + j / 8 + shift, None if s == "val" else 0.25)
            for i, n in enumerate(names) for j, m in enumerate(["acc_avg", "F1-macro_all"]) for s in ("train", "val", "test")]
    return spark.createDataFrame(rows, LONG)


def _rows(df):
    return sorted((r.name, r.metric, r.split, r.mean, r.std) for r in df.where("mean is not null").collect())


def test_report_format_round_trip(spark, monkeypatch):
    path = os.path.join(tempfile.mkdtemp(), "made", "here")
    summary = _summary(spark, ["a/b c", "ü=1", "x_lr_1e-05"])
    report_format.save_reports(summary, path)
    assert sorted(_rows(report_format.load_reports(spark, path)), key=repr) == sorted(_rows(summary), key=repr)
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    # one CSV per experiment in the layout of S5, so S4's other reader reads it as well
    plain = _summary(spark, ["plain"])
    report_format.save_reports(plain, path)                           # overwrite: the others are gone
    assert os.listdir(path) == ["name=plain"]
    assert _rows(reports.read_reports(spark, path)) == _rows(plain)
    report_format.save_reports(_summary(spark, ["more"], 1.0), path, mode="append")
    report_format.save_reports(_summary(spark, ["plain"], 5.0), path, mode="append")      # replaces one report
    want = _rows(_summary(spark, ["more"], 1.0)) + _rows(_summary(spark, ["plain"], 5.0))
    assert _rows(report_format.load_reports(spark, path)) == sorted(want)


def test_reading_has_a_partition_per_group_of_folders(spark):
    path = tempfile.mkdtemp()
    report_format.save_reports(_summary(spark, [f"n{i:03d}" for i in range(130)]), path)
    back = report_format.load_reports(spark, path)
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() == 3
    assert back.where("mean is not null").count() == 130 * 6


def test_a_failed_task_leaves_no_report(spark):
    path = tempfile.mkdtemp()
    report_format.save_reports(_summary(spark, ["old"]), path)
    bad = _summary(spark, [f"n{i}" for i in range(8)]).withColumn(
        "split", F.when(F.col("name") == "n7", F.lit("nosuch")).otherwise(F.col("split")))
    with pytest.raises(Exception, match="unknown split"):
        report_format.save_reports(bad, path)
    assert os.listdir(path) == ["name=old"] and len(_rows(report_format.load_reports(spark, path))) == 6


def test_rows_of_one_report_in_several_tasks_are_refused(spark):
    path = tempfile.mkdtemp()
    report_format.register_report_format(spark)
    with pytest.raises(Exception, match="several tasks"):
        _summary(spark, ["a"]).repartition(3).write.format(report_format.FORMAT).mode("append").save(path)
    assert os.listdir(path) == []


def test_artifacts_are_found_in_storage(spark):
    root = tempfile.mkdtemp()
    keys = {"arch": "string", "run": "int"}
    layout = r"/([^/]+)/run_(\d+)/checkpoint_best$"
    for arch, run, name, text in [("RN50", 1, "checkpoint_best", "w"), ("RN50", 2, "checkpoint_best", "w"),
                                  ("RN50", 3, "checkpoint_best", ""), ("ViT", 1, "checkpoint_12", "w"),
                                  ("ViT", 2, "checkpoint_best", "w"), ("ViT", 2, "notes.txt", "w")]:
        os.makedirs(f"{root}/{arch}/run_{run}", exist_ok=True)
        with open(f"{root}/{arch}/run_{run}/{name}", "w") as f:
            f.write(text)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold")
    found = artifacts.stored_artifacts(spark, root, layout, keys)
    assert {tuple(r) for r in found.collect()} == {("RN50", 1), ("RN50", 2), ("ViT", 2)}
    expected = spark.createDataFrame([(a, r) for a in ("RN50", "ViT") for r in (1, 2, 3)], "arch string, run int")
    missing = experiments.missing_artifacts(expected, found, ["arch", "run"])
    assert {tuple(r) for r in missing.collect()} == {("RN50", 3), ("ViT", 1), ("ViT", 3)}
    with pytest.raises(FileNotFoundError):
        experiments.require_artifacts(expected, found, ["arch", "run"])
    assert artifacts.stored_files(spark, root, "*.txt").count() == 1
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold") == before
    with pytest.raises(Exception):
        artifacts.stored_files(spark, root + "/none")


def test_listing_runs_in_tasks(spark):
    root = tempfile.mkdtemp()
    for i in range(5):
        os.makedirs(f"{root}/d{i}")
        open(f"{root}/d{i}/f", "w").write("x")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        artifacts.stored_files(spark, root)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) is not None
        jobs = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup("listing")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(list(jobs)) >= 1


@pytest.mark.parametrize("world, parts, pad", [(4, 1, True), (3, 1, False), (3, 4, True)])
def test_partition_r_is_shard_r(spark, world, parts, pad):
    items = spark.range(101).select((F.col("id") * 7 % 101).alias("item_id"))
    placed = sampling.place_shards(items, world, pad=pad, parts=parts)
    got = placed.select("*", F.spark_partition_id().alias("p")).collect()
    assert len(got) == (-(-101 // world) * world if pad else 101)
    assert {r.p // parts == r.shard for r in got} == {True} and {r.p for r in got} == set(range(world * parts))
    sizes = [sum(r.shard == s for r in got) for s in range(world)]
    assert max(sizes) - min(sizes) <= (0 if pad else 1)
    path = tempfile.mkdtemp()
    sampling.write_shards(items, path, world, pad=pad, parts=parts)
    for s in range(world):
        assert len(glob.glob(f"{path}/shard={s}/*.parquet")) == parts
        own = [r.position for r in sampling.read_shard(spark, path, s).orderBy("position").collect()]
        assert own == sorted(r.position for r in got if r.shard == s) and all(x % world == s for x in own)
        for f in glob.glob(f"{path}/shard={s}/*.parquet"):
            at = [r.position for r in spark.read.parquet(f).collect()]
            assert at == sorted(at)


def test_predictions_of_runs_join_without_a_shuffle(spark):
    names = {}
    for run in ("a", "b"):
        names[run] = f"test_predictions_{run}"
        probs = spark.range(500).select(F.col("id").alias("item_id"), (F.col("id") % 3).cast("int").alias("y_true"),
                                        F.array(F.rand(1), F.rand(2)).alias("probs"))
        assert scoring.write_predictions(probs, names[run], buckets=4) == 500
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scoring.join_predictions(spark, names)
        assert joined.count() == 500 and joined.columns == ["item_id", "y_true", "a", "b"]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in names.values():
            spark.sql(f"DROP TABLE {t}")
