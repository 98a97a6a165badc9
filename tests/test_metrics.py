from pyspark.sql import functions as F
import math


from shiftlab.operators import metrics, summaries


def _preds(spark, rows):
    return spark.createDataFrame(rows, "run int, split string, item_id long, y_true int, y_pred int, domain int")


def test_accuracy_and_groups(spark):
    p = _preds(spark, [(0, "test", 1, 0, 0, 0), (0, "test", 2, 1, 0, 0), (0, "test", 3, 1, 1, 1)])
    acc = metrics.accuracy(p).first()
    assert math.isclose(acc.acc_avg, 2 / 3) and acc.n == 3
    g = {r.domain: (r.acc, r.n) for r in metrics.group_accuracy(p).collect()}
    assert g == {0: (0.5, 2), 1: (1.0, 1)}           # a domain with one row
    w = metrics.worst_group(p).first()
    assert w.acc_wg == 0.5 and w.worst_group == 0


def test_worst_group_tie_lowest_id(spark):
    p = _preds(spark, [(0, "t", 1, 0, 1, 3), (0, "t", 2, 0, 1, 2)])
    assert metrics.worst_group(p).first().worst_group == 2


def test_macro_f1_over_true_classes_only(spark):
    # class 2 is predicted but never true: it is not averaged; class 1 true but never predicted -> f1 0
    p = _preds(spark, [(0, "t", 1, 0, 0, 0), (0, "t", 2, 0, 2, 0), (0, "t", 3, 1, 2, 0)])
    per = {r.class_id: r for r in metrics.per_class_prf(p).collect()}
    assert set(per) == {0, 1}
    assert per[0].precision == 1.0 and per[0].recall == 0.5 and math.isclose(per[0].f1, 2 / 3)
    assert per[1].precision == 0.0 and per[1].recall == 0.0 and per[1].f1 == 0.0
    assert math.isclose(metrics.macro_f1(p).first().f1_macro, 1 / 3)


def test_confusion_trace_equals_accuracy(spark):
    p = _preds(spark, [(0, "t", i, i % 3, (i * 7) % 3, 0) for i in range(30)])
    cm = metrics.confusion(p).collect()
    trace = sum(r.n for r in cm if r.y_true == r.y_pred)
    assert math.isclose(trace / 30, metrics.accuracy(p).first().acc_avg)


def test_run_metrics_long(spark):
    p = _preds(spark, [(0, "t", 1, 0, 0, 0), (0, "t", 2, 1, 0, 1)])
    m = {r.metric: r.value for r in metrics.run_metrics(p).collect()}
    assert m == {"acc_avg": 0.5, "acc_wg": 0.0, "F1-macro_all": (2 / 3 + 0) / 2}


def test_epoch_loss_is_mean_of_batch_means(spark):
    # batches of 2 and 1 rows: mean of means differs from the per-item mean
    s = spark.createDataFrame([(0, 0, [0.0, 0.0], 0), (0, 0, [0.0, 0.0], 0), (0, 1, [2.0, 0.0], 0)],
                              "epoch int, batch int, scores array<double>, y_true int")
    loss = metrics.epoch_loss(s, ["epoch"]).first().loss
    ce0 = math.log(2.0)
    ce1 = math.log(math.exp(2.0) + 1.0) - 2.0
    assert math.isclose(loss, (ce0 + ce1) / 2)


def test_headline_metric(spark):
    m = spark.createDataFrame([("iwildcam_0", "acc_avg", 1.0), ("iwildcam_0", "F1-macro_all", 0.5),
                               ("fmow", "acc_avg", 0.7), ("fmow", "F1-macro_all", 0.1)],
                              "dataset string, metric string, value double")
    got = {(r.dataset, r.metric) for r in metrics.headline_metric(m).collect()}
    assert got == {("iwildcam_0", "F1-macro_all"), ("fmow", "acc_avg")}


def test_run_and_recall_summary_std_definitions(spark):
    one = spark.createDataFrame([("t", "acc_avg", 0.5)], "split string, metric string, value double")
    assert summaries.run_summary(one).first()["std"] is None          # sample std of one run
    two = spark.createDataFrame([("t", "acc_avg", 0.5), ("t", "acc_avg", 0.7)], "split string, metric string, value double")
    assert math.isclose(summaries.run_summary(two).first()["std"], 0.1414213562, rel_tol=1e-9)
    r1 = spark.createDataFrame([(0.5,)], "recall_at_k double")
    assert summaries.recall_summary(r1).first()["std"] == 0.0          # population std of one run
    r2 = spark.createDataFrame([(0.5,), (0.7,)], "recall_at_k double")
    assert math.isclose(summaries.recall_summary(r2).first()["std"], 0.1, rel_tol=1e-9)


def test_wide_report_columns(spark):
    s = spark.createDataFrame([("train", "acc_avg", 0.9, 0.01), ("test", "acc_avg", 0.5, 0.02)],
                              "split string, metric string, mean double, std double")
    w = summaries.wide_report(s)
    assert w.columns[:3] == ["metric", "Train|mean", "Train|std"]
    assert w.columns[-2:] == ["OOD Test|mean", "OOD Test|std"]
    r = w.first()
    assert r["Train|mean"] == 0.9 and r["OOD Test|std"] == 0.02 and r["ID Val|mean"] is None


def test_vector_mean_and_swa(spark):
    df = spark.createDataFrame([("w", e, [float(e), 1.0]) for e in range(5)], "param string, epoch int, v array<double>")
    m = summaries.swa_mean(df, n_epochs=5, swa_epochs=2).first()
    assert m.v == [3.5, 1.0]                                            # epochs 3 and 4


def test_dataset_summary(spark):
    items = spark.createDataFrame([("train", i, i % 2, i % 3) for i in range(5)] + [("test", 9, 0, 0)],
                                  "split string, item_id int, y_true int, domain int")
    got = {r.split: r for r in metrics.dataset_summary(items, batch_size=2).collect()}
    assert got["train"].n_rows == 5 and got["train"].n_batches == 3 and got["train"].n_classes == 2
    assert got["train"].n_groups == 3 and got["test"].n_total == 6


def test_report_reads_predictions_once(spark):
    from shiftlab.plans import report
    from shiftlab.sources import fixtures as fx
    from conftest import SF_SMALL
    df = report.evaluation_report(fx.order_predictions(spark, SF_SMALL))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("orders.parquet") == 1            # one linear pipeline, no self-joins


def test_slice_metrics_with_any_group_type(spark):
    rows = [(0, "a", g, 1, p) for g, p in ((1.2, 1), (1.2, 1), (1.7, 0), (None, 1))]
    df = spark.createDataFrame(rows, "run int, split string, g double, y_true int, y_pred int")
    r = metrics.slice_metrics(df, ["run", "split"], "g").first()
    assert r.acc_avg == 0.75 and r.acc_wg == 0.0 and r.n == 4
    named = df.withColumn("g", F.when(F.col("g") == 1.2, "asia").when(F.col("g") == 1.7, "europe"))
    assert metrics.slice_metrics(named, ["run", "split"], "g").first().acc_wg == 0.0
