import json
import os
import tempfile
import warnings

import pytest
from pyspark.sql import functions as F

from shiftlab.operators import experiments
from shiftlab.sources import classes as S2
from shiftlab.sources import fixtures as fx
from shiftlab.sources import grid as S3
from shiftlab.sources import items as S1
from shiftlab.sources import logs as S67
from shiftlab.sources import reports as S45
from conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="shiftlab-src-")


def test_read_items_prunes_and_checks(spark):
    path = os.path.join(_tmp(), "items")
    items = fx.embedding_items(spark, SF_SMALL).filter(F.col("split") != "id_val")
    S1.write_items(items, path)
    df = S1.read_items(spark, path, "embeddings", ["test"])
    assert df.select("split").distinct().collect()[0].split == "test"
    assert "PartitionFilters" in df._jdf.queryExecution().executedPlan().toString()
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert S1.read_items(spark, path, "embeddings", ["id_val"]).count() == 0
        assert any("missing" in str(x.message) for x in w)
    with pytest.raises(ValueError):
        S1.read_items(spark, path, "nope", ["test"])
    no_train = os.path.join(_tmp(), "items2")
    S1.write_items(items.filter(F.col("split") != "train"), no_train)
    with pytest.raises(ValueError):
        S1.read_items(spark, no_train, "embeddings", ["train"])


def test_single_domain_variant(spark):
    items = fx.embedding_items(spark, SF_SMALL)
    df = S1.read_items(spark, items, "embeddings_0", check=False)
    assert {r.domain for r in df.filter(F.col("split") == "train").select("domain").distinct().collect()} == {0}


def test_class_prompts_duplicate_names(spark):
    c = S2.class_prompts_from_list(spark, ["unknown bird", "deer", "unknown bird"], "iwildcam_0")
    rows = c.orderBy("class_id").collect()
    assert [r.class_id for r in rows] == [0, 1, 2]
    assert rows[2].prompt == "this is a photo of unknown bird" and rows[0].dataset == "iwildcam"
    with pytest.raises(ValueError):
        S2.prompt_prefix("imagenet")


def test_grid_json_roundtrip_and_expand(spark):
    path = os.path.join(_tmp(), "grid.json")
    with open(path, "w") as f:
        json.dump({"archs": ["a", "b"], "percs": [0, 0.03, 1], "lrs": [0.01, 1e-05]}, f)
    g = S3.read_grid(spark, path)
    train = experiments.expand_grid(g, "train").collect()
    test = experiments.expand_grid(g, "test").collect()
    assert len(train) == 2 * 2 * 2 and len(test) == len(train) + 2
    assert {r.lr_label for r in train} == {"0.01", "1e-05"}             # JSON text kept
    zs = [r for r in test if r.lr_ord is None]
    assert all(r.perc == 0.0 for r in zs)
    names = {r.name for r in experiments.run_names(experiments.expand_grid(g, "test"), "fmow").collect()}
    assert "fmow_a_zeroshot" in names and "fmow_b_perctrain_0.03_lr_1e-05" in names


def test_report_roundtrip(spark):
    summ = spark.createDataFrame([("e1", "train", "acc_avg", 0.9, 0.1), ("e1", "test", "acc_avg", 0.5, None),
                                  ("e2", "val", "F1-macro_all", 0.25, 0.0)],
                                 "name string, split string, metric string, mean double, std double")
    path = os.path.join(_tmp(), "reports")
    S45.write_reports(summ, path)
    files = [os.path.join(r, f) for r, _, fs in os.walk(os.path.join(path, "name=e1")) for f in fs if f.endswith(".csv")]
    lines = open(files[0]).read().splitlines()
    assert lines[0].startswith(",Train,Train,ID Val") and lines[1].startswith(",mean,std")
    back = {(r.name, r.metric, r.split): (r.mean, r.std) for r in S45.read_reports(spark, path).collect()}
    assert back[("e1", "acc_avg", "train")] == (0.9, 0.1)
    assert back[("e1", "acc_avg", "test")] == (0.5, None)
    assert back[("e2", "F1-macro_all", "val")] == (0.25, 0.0)


def test_epoch_log_roundtrip(spark):
    log = spark.createDataFrame([(0, 4, 0.5), (0, 0, 0.1), (1, 0, 0.2)], "run int, epoch int, metric double")
    arr = {r.run: (r.epoch, r.acc_avg) for r in S67.epoch_log_arrays(log, "acc_avg").collect()}
    assert arr[0] == ([0, 4], [0.1, 0.5])
    path = os.path.join(_tmp(), "log")
    S67.write_epoch_log(log, path, "acc_avg")
    back = sorted(tuple(r) for r in S67.read_epoch_log(spark, path, "acc_avg").collect())
    assert back == [(0, 0, 0.1), (0, 4, 0.5), (1, 0, 0.2)]


def test_summary_json(spark):
    rec = spark.createDataFrame([("a", "d", 1, 0.25), ("a", "d", 0, 0.5)], "arch string, dataset string, run int, recall_at_k double")
    j = json.loads(S67.recall_json(rec).first().json)
    assert j == {"arch": "a", "dataset": "d", "recall_at_k": [0.5, 0.25]}


def test_model_registry_lists_valid_names(spark):
    import numpy as np
    from shiftlab.operators import inference
    inference.register_model("linear_stub", inference.linear_model_factory(np.eye(2)))
    with pytest.raises(ValueError, match="linear_stub"):
        inference.get_model("resnet999")
    df = spark.createDataFrame([(1, [1.0, 2.0])], "item_id long, features array<float>")
    out = inference.infer(df, inference.get_model("linear_stub"), width=2).first()
    assert out.scores == [1.0, 2.0]


def test_single_report_file(spark):
    summ = spark.createDataFrame([("train", "acc_avg", 0.9, 0.1), ("test", "F1-macro_all", 0.5, 0.05)],
                                 "split string, metric string, mean double, std double")
    path = os.path.join(_tmp(), "one")
    S45.write_report(summ, path)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(files[0]).read().splitlines()
    assert lines[0] == ",Train,Train,ID Val,ID Val,ID Test,ID Test,OOD Val,OOD Val,OOD Test,OOD Test"
    assert lines[1] == ",mean,std,mean,std,mean,std,mean,std,mean,std"
    assert [l.split(",")[0] for l in lines[2:]] == ["F1-macro_all", "acc_avg"]
    back = {(r.metric, r.split): (r.mean, r.std) for r in S45.read_reports(spark, path).collect()}
    assert back[("acc_avg", "train")] == (0.9, 0.1) and back[("F1-macro_all", "test")] == (0.5, 0.05)
    assert back[("acc_avg", "val")] == (None, None)


def test_default_grid_sizes_and_paths(spark):
    g = S3.grid_from_lists(spark)
    train = experiments.expand_grid(g, "train")
    assert train.count() == 128 and experiments.expand_grid(g, "test").count() == 132
    p = experiments.run_paths(train, "fmow", "/m", "/l").filter(
        (F.col("arch") == "vitb32_clip_finetune") & (F.col("perc_label") == "0.03") & (F.col("lr_label") == "1e-05")).first()
    assert p.model_path == "/m/fmow/perc_train_0.03/lr_1e-05" and p.arch_file == "ViTB32_clip_finetune"


def test_default_grid_keeps_its_128_run_names(spark, tmp_path):
    from shiftlab.operators import experiments
    from shiftlab.sources import grid as S3
    grid = S3.grid_from_lists(spark)
    path = str(tmp_path / "grid")
    S3.write_grid(grid, path)
    import json
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert json.loads(text)["lrs"] == [0.01, 0.001, 0.0001, 1e-05]
    names = lambda g: {r.name for r in experiments.run_names(experiments.expand_grid(g, "train"), "iwildcam").collect()}
    assert names(S3.read_grid(spark, path)) == names(grid) and len(names(grid)) == 128
    assert "iwildcam_vitb32_clip_finetune_perctrain_1_lr_1e-05" in names(grid)


def test_report_names_and_other_splits_come_back(spark, tmp_path):
    from shiftlab.sources import reports
    rows = [("a b+c:0", "id_test", "acc_avg", 0.1 + 0.2, None), ("a b+c:0", "test", "acc_avg", 0.25, 0.5),
            ("x%3A/y", "test", "acc_avg", 1e-9, 0.0)]
    summary = spark.createDataFrame(rows, "name string, split string, metric string, mean double, std double")
    path = str(tmp_path / "reports")
    reports.write_reports(summary, path, splits=["id_test", "test"])
    back = reports.read_reports(spark, path, splits=["id_test", "test"]).filter("mean is not null")
    assert {(r.name, r.split, r.metric, r.mean, r.std) for r in back.collect()} == {tuple(r) for r in rows}


def test_zero_shot_rows_have_no_paths_and_swa_names_end_in_swa(spark):
    from shiftlab.operators import experiments as X
    from shiftlab.sources import grid as S3
    rows = X.expand_grid(S3.grid_from_lists(spark, ["m"], [0, 0.5], [0.01]), "test")
    paths = {r.perc: r.model_path for r in X.run_paths(rows, "fmow", "/m", "/l").collect()}
    assert paths == {0.0: None, 0.5: "/m/fmow/perc_train_0.5/lr_0.01"}
    assert [r.name for r in X.run_names(rows, "fmow", swa=True).collect()] == ["fmow_m_perctrain_0.5_lr_0.01_swa"]
    need = X.expected_checkpoints(rows, 2, ("best", "swa"))
    assert sorted((r.run, r.kind) for r in need.collect()) == [(1, "best"), (1, "swa"), (2, "best"), (2, "swa")]
    have = need.filter("run = 1")
    assert X.missing_artifacts(need, have, ["arch", "perc_label", "lr_label", "run", "kind"]).count() == 2


def test_cells_without_results_stay_or_raise(spark):
    import pytest

    from shiftlab.operators import experiments as X
    grid = spark.createDataFrame([("m", 0, None), ("m", 1, 0), ("m", 1, 1)], "arch string, perc_ord int, lr_ord int")
    res = spark.createDataFrame([("m", 0, None, 0.5), ("m", 1, 0, 0.6)], "arch string, perc_ord int, lr_ord int, ood_mean double")
    got = {(r.perc_ord, r.lr_ord): r.ood_mean for r in X.join_results(grid, res).collect()}
    assert got == {(0, None): 0.5, (1, 0): 0.6, (1, 1): None}
    with pytest.raises(FileNotFoundError):
        X.join_results(grid, res, require=True)
