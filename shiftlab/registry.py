"""Registered queries: one callable ``(spark, data_dir) -> DataFrame`` per operator.

Every query reads the driver tables through the fixtures, so its work grows
with them. Names match ``shiftlab.oracle.ORACLE`` where an oracle exists.
Real-valued outputs whose summation order differs by engine are rounded to 6
decimals (the oracle rounds the same way); exact ones are returned as they are.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlab.functions import vectors as V
from shiftlab.operators import (experiments, inference, many_prompts, metrics, retrieval, sampling, scoring,
                                selection, summaries)
from shiftlab.plans import limited_data, probe, report, retrieval_eval, training, zero_shot
from shiftlab.session import scratch_path
from shiftlab.sources import artifacts, report_format
from shiftlab.sources import classes as S2
from shiftlab.sources import fixtures as fx
from shiftlab.sources import grid as S3
from shiftlab.sources import items as S1
from shiftlab.sources import logs as S67
from shiftlab.sources import reports as S45
from shiftlab.sources.tables import is_folder, read_table
from shiftlab.streaming.evaluation import streaming_confusion
from shiftlab.streaming.top_k import streaming_recall_at_k, streaming_top_k
from shiftlab.streaming.top_n import streaming_top_n

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _items_and_classes(spark, d):
    items = fx.embedding_items(spark, d)
    return items, summaries.class_vectors(items)


def _head(classes: DataFrame) -> DataFrame:
    """A linear head from the class centroids: ``w = centroid``, ``b = class_id / 10``."""
    return classes.select("class_id", F.col("vec").alias("w"), (F.col("class_id") / 10.0).alias("b"))


def _long_scores(scored: DataFrame, name: str = "score") -> DataFrame:
    long = V.explode_vector(scored, "item_id", "scores", "class_id", name)
    return long.select("item_id", "class_id", r6(name).alias(name))


# --- P: projections and scoring --------------------------------------------

@register("l2_normalize")
def q_l2_normalize(spark, d):
    items = fx.embedding_items(spark, d)
    return items.select("item_id", F.posexplode(V.l2_normalize("features")).alias("pos", "value")) \
                .select("item_id", "pos", r6("value").alias("value"))


@register("contrastive_scores")
def q_contrastive_scores(spark, d):
    items, classes = _items_and_classes(spark, d)
    return _long_scores(scoring.contrastive_scores(items.select("item_id", "features"), classes))


@register("linear_scores")
def q_linear_scores(spark, d):
    items, classes = _items_and_classes(spark, d)
    return _long_scores(scoring.linear_scores(items.select("item_id", "features"), _head(classes)))


@register("softmax_probs")
def q_softmax_probs(spark, d):
    items, classes = _items_and_classes(spark, d)
    s = scoring.contrastive_scores(items.select("item_id", "features"), classes)
    return _long_scores(s.select("item_id", V.softmax("scores").alias("scores")), "prob")


@register("argmax_predictions")
def q_argmax_predictions(spark, d):
    items, classes = _items_and_classes(spark, d)
    s = scoring.contrastive_scores(items.select("item_id", "features"), classes)
    return s.select("item_id", V.argmax_class("scores").alias("y_pred"))


@register("prediction_table")
def q_prediction_table(spark, d):
    items, classes = _items_and_classes(spark, d)
    p = scoring.predict_table(items, classes)
    long = V.explode_vector(p, ["item_id", "y_true"], "probs", "class_id", "prob")
    return long.select("item_id", "y_true", "class_id", r6("prob").alias("prob"))


@register("prediction_table_bucketed")
def q_prediction_table_bucketed(spark, d):
    """Two runs written once each and joined bucket by bucket; their scale does not change the class."""
    items, classes = _items_and_classes(spark, d)
    tables, n = {}, 0
    for name, scale in (("a", 100.0), ("b", 50.0)):
        tables[name] = f"predictions_{name}_{uuid.uuid4().hex}"
        n = scoring.write_predictions(scoring.predict_table(items, classes, scale=scale), tables[name])
    both = scoring.join_predictions(spark, tables)
    y_pred = V.argmax_class("a")
    return both.select("item_id", y_pred.alias("y_pred"), (y_pred == V.argmax_class("b")).alias("same"),
                       F.lit(n).cast("bigint").alias("n_rows"))


@register("standardize_pixels")
def q_standardize_pixels(spark, d):
    px = fx.embedding_pixels(spark, d).select("item_id", F.posexplode(V.standardize("pixel")).alias("pos", "value"))
    return px.select("item_id", "pos", r6("value").alias("value"))


# --- J / F: joins and filters ----------------------------------------------

@register("score_pairs")
def q_score_pairs(spark, d):
    items, classes = _items_and_classes(spark, d)
    return scoring.score_pairs(items, classes).select("item_id", "class_id", r6("score").alias("score"))


@register("single_domain_filter")
def q_single_domain_filter(spark, d):
    items = S1.read_items(spark, fx.embedding_items(spark, d), "embeddings_0", check=False)
    return items.select("item_id", "split", "domain")


# --- A: aggregations --------------------------------------------------------

@register("accuracy_by_split")
def q_accuracy(spark, d):
    return metrics.accuracy(fx.order_predictions(spark, d), ["run", "split"])


@register("group_accuracy")
def q_group_accuracy(spark, d):
    return metrics.group_accuracy(fx.order_predictions(spark, d), ["run", "split"], "domain")


@register("worst_group")
def q_worst_group(spark, d):
    return metrics.worst_group(fx.order_predictions(spark, d), ["run", "split"], "domain")


@register("confusion_counts")
def q_confusion(spark, d):
    return metrics.confusion(fx.order_predictions(spark, d), ["run", "split"])


@register("per_class_prf")
def q_per_class_prf(spark, d):
    p = metrics.per_class_prf(fx.order_predictions(spark, d), ["run", "split"])
    return p.select("run", "split", "class_id", "tp", "support", "predicted",
                    r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("macro_f1")
def q_macro_f1(spark, d):
    m = metrics.macro_f1(fx.order_predictions(spark, d), ["run", "split"])
    return m.select("run", "split", r6("f1_macro").alias("f1_macro"))


@register("epoch_loss")
def q_epoch_loss(spark, d):
    items, classes = _items_and_classes(spark, d)
    scored = scoring.contrastive_scores(items.select("item_id", "split", "features", "y_true"), classes)
    # one number per row before the rows are indexed: neither features nor scores are shuffled
    ce = scored.select("item_id", "split", V.cross_entropy("scores", "y_true").alias("ce"))
    gi = sampling.group_index(ce, "split")
    loss = metrics.epoch_loss(gi.withColumn("batch", F.expr("gidx div 32")), ["split"], "batch", row_loss="ce")
    return loss.select("split", r6("loss").alias("loss"), "n_batches")


def _fx3_metrics(spark, d):
    return metrics.run_metrics(fx.order_predictions(spark, d), ["run", "split"], "domain")


@register("headline_metric")
def q_headline_metric(spark, d):
    m = _fx3_metrics(spark, d).withColumn("dataset", F.explode(F.array(F.lit("iwildcam"), F.lit("fmow"))))
    h = metrics.headline_metric(m)
    return h.select("dataset", "run", "split", "metric", r6("value").alias("value"))


@register("run_summary")
def q_run_summary(spark, d):
    s = summaries.run_summary(_fx3_metrics(spark, d))
    return s.select("split", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")


def _run_classes(items: DataFrame, runs: int = 3) -> DataFrame:
    """Per-run class centroids: run r leaves out the train items with ``item_id % runs == r``."""
    tr = items.filter(F.col("split") == "train").withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    tr = tr.filter(F.col("item_id") % runs != F.col("run"))
    return summaries.vector_mean(tr.select("run", F.col("y_true").alias("class_id"), F.col("features").alias("v")),
                                 ["run", "class_id"], "v", out="vec")


def _n_classes(items: DataFrame) -> int:
    return int(items.agg(F.max("y_true")).first()[0]) + 1


@register("recall_summary")
def q_recall_summary(spark, d):
    items = fx.embedding_items(spark, d)
    n_classes = _n_classes(items)
    rec = retrieval_eval.retrieval_recalls(items, _run_classes(items), 3, n_classes, k=10, split="val")
    s = summaries.recall_summary(rec)
    return s.select(r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")


@register("wide_report")
def q_wide_report(spark, d):
    w = report.evaluation_report(fx.order_predictions(spark, d))
    return w.select("metric", *[r6(c).alias(c) for c in w.columns if c != "metric"])


@register("vector_mean")
def q_vector_mean(spark, d):
    swa = summaries.swa_mean(fx.embedding_param_vectors(spark, d), n_epochs=30, swa_epochs=10)
    return swa.select("param", F.posexplode("v").alias("pos", "value")) \
              .select("param", "pos", r6("value").alias("value"))


@register("dataset_summary")
def q_dataset_summary(spark, d):
    return metrics.dataset_summary(fx.embedding_items(spark, d), batch_size=32)


@register("rows_per_group")
def q_rows_per_group(spark, d):
    return metrics.rows_per_group(fx.embedding_items(spark, d))


# --- T: top-k, windows, selection -------------------------------------------

def _query_vector(classes: DataFrame, class_id: int = 0) -> DataFrame:
    return classes.filter(F.col("class_id") == class_id).select("vec")


@register("global_top_n")
def q_global_top_n(spark, d):
    items, classes = _items_and_classes(spark, d)
    t = retrieval.top_n(items, _query_vector(classes), n=5)
    return t.select("rank", "item_id", r6("similarity").alias("similarity"))


@register("many_prompts_top_n")
def q_many_prompts_top_n(spark, d):
    items, classes = _items_and_classes(spark, d)
    hits, _ = many_prompts.top_n_many(items, classes, n=5)
    return hits.select("prompt_id", "rank", "item_id", r6("similarity").alias("similarity"))


def _nation_classes(spark, d, dataset="fmow_0"):
    vocab = read_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("class_id"), F.lower("n_name").alias("class_name"))
    return S2.class_prompts(vocab, dataset)


@register("retrieval_labels")
def q_retrieval_labels(spark, d):
    items, classes = _items_and_classes(spark, d)
    hits = retrieval.top_n(items, _query_vector(classes), n=5)
    j = retrieval.attach_labels(hits, items, _nation_classes(spark, d))
    return j.select("rank", "item_id", r6("similarity").alias("similarity"), "y_true", "class_name")


def _test_probs(spark, d, split="test"):
    items, classes = _items_and_classes(spark, d)
    W, _ = scoring.collect_class_matrix(classes)
    ev = items.filter(F.col("split") == split).select("item_id", "features", "y_true")
    s = scoring.scores_from_matrix(ev, W, scale=100.0, normalize=True)
    return s.select("item_id", "y_true", V.softmax("scores").alias("probs")), W.shape[0]


@register("top_k_per_class")
def q_top_k_per_class(spark, d):
    probs, _ = _test_probs(spark, d)
    return retrieval.top_k_per_class(probs, k=20).select("class_id", "rank", "item_id")


@register("recall_at_k_per_class")
def q_recall_at_k_per_class(spark, d):
    probs, n = _test_probs(spark, d)
    r = retrieval.recall_at_k_per_class(probs, 20, n)
    return r.select("class_id", r6("recall").alias("recall"))


@register("recall_at_k")
def q_recall_at_k(spark, d):
    probs, n = _test_probs(spark, d)
    return retrieval.recall_at_k(probs, 20, n).select(r6("recall_at_k").alias("recall_at_k"))


@register("recall_at_k_large_k")
def q_recall_at_k_large_k(spark, d):
    probs, n = _test_probs(spark, d, split="id_test")
    return retrieval.recall_at_k(probs, 200, n).select(r6("recall_at_k").alias("recall_at_k"))


@register("checkpoint_flags")
def q_checkpoint_flags(spark, d):
    f = selection.checkpoint_flags(fx.event_epoch_log(spark, d), eval_freq=5)
    # FX4 metrics are one integer sum and one division: exact in both engines, not rounded
    return f.select("run", "epoch", "metric", "is_best")


@register("best_checkpoint")
def q_best_checkpoint(spark, d):
    b = selection.best_checkpoint(fx.event_epoch_log(spark, d), eval_freq=5)
    return b.select("run", "best_epoch", "best_metric", "checkpoint_epoch")


def _fx5_summary(spark, d):
    res = fx.lineitem_grid_results(spark, d)
    g = res.groupBy("arch", "perc_ord", "lr_ord").agg(
        F.avg("id_metric").alias("id_mean"), F.avg("ood_metric").alias("ood_mean"),
        F.stddev_samp("id_metric").alias("id_std"), F.stddev_samp("ood_metric").alias("ood_std"))
    # the zero-shot fraction has a single setting: its first lr
    return g.filter((F.col("perc_ord") != 0) | (F.col("lr_ord") == 0))


def _best(spark, d):
    return selection.best_lr(_fx5_summary(spark, d))


@register("best_lr")
def q_best_lr(spark, d):
    b = _best(spark, d)
    return b.select("arch", "perc_ord", "lr_ord", *[r6(c).alias(c) for c in ("id_mean", "ood_mean", "id_std", "ood_std")])


@register("curve_series")
def q_curve_series(spark, d):
    b = _best(spark, d).withColumn("perc", F.col("perc_ord") / 100.0)
    c = selection.curve_series(b, error_bars=True)
    return c.select("arch", "label", r6("perc").alias("perc"), "split", r6("value").alias("value"), r6("err").alias("err"))


# --- D: sampling, grouping, sharding ----------------------------------------

@register("group_ids")
def q_group_ids(spark, d):
    p = fx.order_predictions(spark, d).filter(F.col("run") == 0)
    return sampling.group_ids(p, ["domain", "segment"]).select("item_id", "group_id")


@register("subset_fraction")
def q_subset_fraction(spark, d):
    p = fx.order_predictions(spark, d).filter(F.col("run") == 0)
    return sampling.subset_fraction(p, 0.3, seed=7, split="train").filter(F.col("split") == "train") \
                   .select("item_id")


@register("group_weights")
def q_group_weights(spark, d):
    w = sampling.group_weights(fx.embedding_items(spark, d))
    return w.select("item_id", "domain", F.round("weight", 9).alias("weight"))


@register("group_balanced_sample")
def q_group_balanced_sample(spark, d):
    s = sampling.group_balanced_sample(fx.embedding_items(spark, d), n=1000, seed=3)
    return s.select("draw", "item_id", "domain")


@register("shard")
def q_shard(spark, d):
    return sampling.shard(fx.embedding_items(spark, d), world=4).select("item_id", "position", "shard")


@register("shard_padded")
def q_shard_padded(spark, d):
    # the training split is what gets sharded for data-parallel training; its size
    # is not a multiple of the world size, so the padding rows appear
    items = fx.embedding_items(spark, d).filter(F.col("split") == "train")
    return sampling.shard(items, world=4).select("item_id", "position", "shard")


@register("shards_placed")
def q_shards_placed(spark, d):
    """Shards as written for their ranks, each read back from its own folder."""
    items = fx.embedding_items(spark, d).filter(F.col("split") == "train")
    path = scratch_path(spark, "shards")
    sampling.place_shards(items, 4).select("item_id", "position", "shard", (
        F.spark_partition_id() == F.col("shard")).alias("in_place")).write.partitionBy("shard").parquet(path)
    ranks = [sampling.read_shard(spark, path, r) for r in range(4)]
    return reduce(DataFrame.unionByName, ranks).select("item_id", "position", "shard", "in_place")


@register("batches")
def q_batches(spark, d):
    return sampling.batches(fx.embedding_items(spark, d), 32).select("item_id", "batch")


@register("row_index")
def q_row_index(spark, d):
    p = fx.order_predictions(spark, d).select("item_id", "run")
    return sampling.with_index(p, ["item_id", "run"]).select("item_id", "run", "idx")


# --- S: sources and sinks ---------------------------------------------------

@register("items_split_scan")
def q_items_split_scan(spark, d):
    path = scratch_path(spark, "items")
    S1.write_items(fx.embedding_items(spark, d), path)
    items = S1.read_items(spark, path, "embeddings", ["id_test", "test"])
    return items.select("item_id", "split", "y_true", "domain")


@register("class_prompt_dimension")
def q_class_prompt_dimension(spark, d):
    return _nation_classes(spark, d)


def _grid(spark, d):
    path = scratch_path(spark, "grid")
    S3.write_grid(S3.grid_from_results(fx.lineitem_grid_results(spark, d)), path)
    return S3.read_grid(spark, path)


def _grid_cols(g):
    return g.select("arch_ord", "arch", "perc_ord", "perc_label", "lr_ord", "lr_label")


@register("grid_expand_train")
def q_grid_expand_train(spark, d):
    return _grid_cols(experiments.expand_grid(_grid(spark, d), "train"))


@register("grid_expand_test")
def q_grid_expand_test(spark, d):
    return _grid_cols(experiments.expand_grid(_grid(spark, d), "test"))


@register("report_roundtrip")
def q_report_roundtrip(spark, d):
    summ = report.evaluation_summary(fx.order_predictions(spark, d))
    path = scratch_path(spark, "reports")
    S45.write_reports(summ.withColumn("name", F.lit("orders_eval")), path)
    back = S45.read_reports(spark, path)
    return back.select("name", "metric", "split", r6("mean").alias("mean"), r6("std").alias("std"))


@register("report_format_roundtrip")
def q_report_format_roundtrip(spark, d):
    summ = report.evaluation_summary(fx.order_predictions(spark, d))
    path = scratch_path(spark, "report-format")
    report_format.save_reports(summ.withColumn("name", F.lit("orders_eval")), path)
    back = report_format.load_reports(spark, path)
    return back.select("name", "metric", "split", r6("mean").alias("mean"), r6("std").alias("std"))


@register("epoch_log_roundtrip")
def q_epoch_log_roundtrip(spark, d):
    path = scratch_path(spark, "epoch-log")
    S67.write_epoch_log(fx.event_epoch_log(spark, d), path, "acc_avg")
    back = S67.read_epoch_log(spark, path, "acc_avg")
    return back.select("run", "epoch", "metric")


@register("recall_json")
def q_recall_json(spark, d):
    items = fx.embedding_items(spark, d)
    rec = retrieval_eval.retrieval_recalls(items, _run_classes(items), 3, _n_classes(items), k=20)
    rec = rec.withColumn("arch", F.lit("centroid")).withColumn("dataset", F.lit("embeddings"))
    path = scratch_path(spark, "recall-json")
    S67.write_json_lines(S67.recall_json(rec, digits=6), path)
    back = S67.read_json_lines(spark, path)
    return back.select(F.get_json_object("json", "$.arch").alias("arch"),
                       F.get_json_object("json", "$.dataset").alias("dataset"), "json")


@register("best_results_json")
def q_best_results_json(spark, d):
    b = _best(spark, d).withColumn("perc_label", (F.col("perc_ord") / 100.0).cast("string"))
    return S67.best_results_json(b, digits=6)


def _raw_keys(g: DataFrame) -> DataFrame:
    """Grid positions back to the raw result keys (fraction and lr in hundredths)."""
    return (g.withColumn("perc_ord", F.round(F.col("perc_label").cast("double") * 100).cast("int"))
             .withColumn("lr_ord", F.round(F.col("lr_label").cast("double") * 100).cast("int")))


@register("missing_artifacts")
def q_missing_artifacts(spark, d):
    exp = _raw_keys(experiments.expand_grid(_grid(spark, d), "all"))
    exp = exp.select("arch", "perc_ord", "lr_ord", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    keys = ["arch", "perc_ord", "lr_ord", "run"]
    return experiments.missing_artifacts(exp, fx.lineitem_present_artifacts(spark, d), keys).select(*keys)


@register("missing_artifacts_stored")
def q_missing_artifacts_stored(spark, d):
    """The present side is what lies in storage: files written here, listed again in tasks."""
    keys = ["arch", "perc_ord", "lr_ord", "run"]
    root = scratch_path(spark, "artifacts")
    fx.lineitem_present_artifacts(spark, d).select(*keys, F.lit("weights").alias("value")) \
        .write.partitionBy(*keys).text(root)
    present = artifacts.stored_artifacts(
        spark, root, r"/arch=([^/]+)/perc_ord=(\d+)/lr_ord=(\d+)/run=(\d+)/part-[^/]*$",
        {"arch": "string", "perc_ord": "int", "lr_ord": "int", "run": "int"}, "part-*")
    exp = _raw_keys(experiments.expand_grid(_grid(spark, d), "all"))
    exp = exp.select("arch", "perc_ord", "lr_ord", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    return experiments.missing_artifacts(exp, present, keys).select(*keys)


@register("grid_results_join")
def q_grid_results_join(spark, d):
    g = _grid(spark, d).withColumn("archs", F.concat("archs", F.array(F.lit("NO_swa"))))
    rows = _raw_keys(experiments.expand_grid(g, "train"))
    res = _fx5_summary(spark, d)
    j = experiments.join_results(rows, res, swa_results=res.filter(F.col("arch") == "NO"))
    return j.select("arch", "perc_ord", "lr_ord", r6("id_mean").alias("id_mean"), r6("ood_mean").alias("ood_mean"))


# --- M: whole jobs -----------------------------------------------------------

@register("zero_shot_split_domain")
def q_zero_shot_split_domain(spark, d):
    items, classes = _items_and_classes(spark, d)
    return zero_shot.zero_shot_split_domain(items, classes)


@register("zero_shot_report")
def q_zero_shot_report(spark, d):
    items, classes = _items_and_classes(spark, d)
    r = zero_shot.zero_shot_report(items, classes)
    return r.select("split", "metric", r6("value").alias("value"))


@register("retrieval_report")
def q_retrieval_report(spark, d):
    items = fx.embedding_items(spark, d)
    s = retrieval_eval.retrieval_report(items, _run_classes(items), 3, _n_classes(items), k=20)
    return s.select(r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")


@register("evaluation_report")
def q_evaluation_report(spark, d):
    w = report.evaluation_report(fx.order_predictions(spark, d), group="nation")
    return w.select("metric", *[r6(c).alias(c) for c in w.columns if c != "metric"])


def _at_least(rate: str, n: str) -> F.Column:
    """A rate less two standard errors: what a probe must reach that knows the rate."""
    p = F.col(rate)
    return p - 2 * F.sqrt(p * (1 - p) / F.col(n))


@register("linear_probe")
def q_linear_probe(spark, d):
    r = probe.probe_report(fx.document_items(spark, d), n_classes=4)
    # the solver's numbers have no SQL twin; what must hold of them has: the fitted head is no
    # worse on its training rows than guessing their shares, which is one of the heads it chose from
    beats = F.when(F.col("split") == "train", F.col("loss") <= F.col("prior_loss"))
    return r.select("split", "n", r6("majority").alias("majority"), r6("prior_loss").alias("prior_loss"),
                    (F.col("acc_avg") >= _at_least("majority", "n")).alias("holds_majority"),
                    beats.alias("beats_prior"), F.col("loss").between(0.0, 1e6).alias("finite_loss"), "converged")


@register("probe_epochs")
def q_probe_epochs(spark, d):
    items = fx.document_items(spark, d).withColumn("features", V.l2_normalize("features"))
    n_epochs, swa = 6, 2
    t = training.train_head(items, n_classes=4, n_epochs=n_epochs, batch_size=1024, lr=0.05, swa_epochs=swa,
                            swa_lr=0.01, eval_freq=2, dataset="documents")
    path = scratch_path(spark, "probe-epochs-log")
    S67.write_epoch_log(t.log, path, "acc_avg")
    log = S67.read_epoch_log(spark, path, "acc_avg")
    # the averaged head against the plain mean of the last heads, weight by weight
    last = t.heads.filter(F.col("epoch") >= n_epochs - swa).select(
        "class_id", F.posexplode(F.concat("w", F.array("b")))).groupBy("class_id", "pos").agg(F.avg("col").alias("mean"))
    got = t.averaged.select("class_id", F.posexplode(F.concat("w", F.array("b"))))
    same = last.join(got, ["class_id", "pos"], "full").agg(
        F.coalesce(F.min((F.abs(F.col("mean") - F.col("col")) < 1e-9).cast("int")), F.lit(0)).alias("same"))
    first = t.losses.filter("epoch = 0").select(F.col("loss").alias("start"))
    best = log.agg(F.max("metric").alias("high")).crossJoin(t.best.select("best_epoch", "best_metric"))
    high = log.join(best, F.col("metric") == F.col("high")).groupBy("best_epoch", "best_metric", "high").agg(
        F.min("epoch").alias("earliest"))
    facts = same.crossJoin(first).crossJoin(high)                                           # one row
    rows = t.batches.groupBy("epoch").agg(F.sum("n").alias("n_draws")).join(t.losses, "epoch")
    rows = rows.join(log.select("epoch", F.lit(True).alias("logged")), "epoch", "left").crossJoin(F.broadcast(facts))
    return rows.select(
        "epoch", "n_draws", "n_batches", F.coalesce("logged", F.lit(False)).alias("evaluated"),
        F.when(F.col("epoch") > 0, F.col("loss") < F.col("start")).alias("loss_falls"),
        (F.col("epoch") > n_epochs - swa - 1).alias("in_mean"), (F.col("same") == 1).alias("swa_is_mean"),
        ((F.col("best_metric") == F.col("high")) & (F.col("best_epoch") == F.col("earliest"))).alias("best_is_first_highest"))


@register("learning_curve")
def q_learning_curve(spark, d):
    items = fx.document_items(spark, d, num_features=256)
    zero = probe.untrained_head(spark, len(fx.DOC_LANGS), 256)
    fractions = [1e-6, 0.1, 1.0]                          # the first one keeps no training row
    curve = probe.learning_curve(items, fractions, [1e-3, 1e-1], runs=2, zero_shot_head=zero)
    counts = items.groupBy("split").count()
    n_train = counts.filter(F.col("split") == "train").first()["count"]
    sizes = spark.createDataFrame([(float(f), sampling.subset_size(n_train, f)) for f in [0.0, *fractions]],
                                  "perc double, n_train long")
    kept = items.filter(F.col("split").isin("id_test", "test")).groupBy("split", "y_true").count() \
        .groupBy("split").agg(F.sum("count").alias("n_eval"), (F.max("count") / F.sum("count")).alias("majority"))
    name = F.when(F.col("split") == "id_test", "ID Test").otherwise("OOD Test")
    facts = curve.join(sizes, "perc").join(kept.select(name.alias("split"), "n_eval", "majority"), "split")
    return facts.select("arch", r6("perc").alias("perc"), "split", "n_train", "n_eval",
                        F.when(F.col("perc") > 0, F.col("value") >= _at_least("majority", "n_eval")).alias("holds_majority"),
                        F.when(F.col("perc") > 0, F.col("err") >= 0).alias("has_spread"))


# --- R: streaming ------------------------------------------------------------

def table_stream(spark, d, name):
    """A file stream over one table of the data folder, one file or a folder of part files
    (new files arrive as batches)."""
    path = f"{d.rstrip('/')}/{name}.parquet"
    reader = (spark.readStream.schema(read_table(spark, d, name).schema).option("maxFilesPerTrigger", 1))
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)   # a file source watches folders


@register("streaming_top_n")
def q_streaming_top_n(spark, d):
    _, classes = _items_and_classes(spark, d)
    q = _query_vector(classes)
    stream = table_stream(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"),
                                                F.col("embedding").alias("features"))
    scored = scoring.contrastive_scores(stream, q.select(F.lit(0).alias("class_id"), "vec"))
    scored = scored.select("item_id", F.element_at("scores", 1).alias("similarity"))
    top = streaming_top_n(scored, 5)
    w = F.row_number().over(Window.orderBy(F.desc("similarity"), F.asc("item_id")))
    # the final state has at most 5 rows
    return top.select(w.cast("int").alias("rank"), "item_id", r6("similarity").alias("similarity"))


def _streamed_top_k(spark, d, k):
    """The top-k of :func:`q_top_k_per_class` over a stream of the embeddings."""
    _, classes = _items_and_classes(spark, d)
    W, _ = scoring.collect_class_matrix(classes)
    items = fx.embedding_items_from(table_stream(spark, d, "embeddings")).filter(F.col("split") == "test")
    scored = scoring.scores_from_matrix(items, W, scale=100.0, normalize=True)
    probs = scored.select("item_id", "y_true", V.softmax("scores").alias("probs"))
    return streaming_top_k(probs, k), len(W)


@register("streaming_top_k")
def q_streaming_top_k(spark, d):
    top, _ = _streamed_top_k(spark, d, 20)
    return top.select("class_id", "rank", "item_id")


@register("streaming_recall")
def q_streaming_recall(spark, d):
    top, n = _streamed_top_k(spark, d, 20)
    return streaming_recall_at_k(top, 20, n).select("class_id", r6("recall").alias("recall"))


@register("streaming_confusion")
def q_streaming_confusion(spark, d):
    orders = table_stream(spark, d, "orders")
    preds = fx.order_predictions_from(orders, spark, d)
    c = streaming_confusion(preds, ["run", "split"])
    return c.select("run", "split", "y_true", "y_pred", "n")


@register("streaming_report")
def q_streaming_report(spark, d):
    orders = table_stream(spark, d, "orders")
    counts = streaming_confusion(fx.order_predictions_from(orders, spark, d), ["run", "split", "domain"])
    m = metrics.run_metrics(None, ["run", "split"], "domain", counts=counts)
    return m.select("run", "split", "metric", r6("value").alias("value"))


# --- U: batch inference --------------------------------------------------------

@register("batch_inference")
def q_batch_inference(spark, d):
    items, classes = _items_and_classes(spark, d)
    W, b = scoring.collect_class_matrix(_head(classes), "class_id", "w", bias_col="b")
    out = inference.infer(items.select("item_id", "features"), inference.linear_model_factory(W, b),
                          width=W.shape[1])
    return _long_scores(out)


# --- wide vocabularies, nullable groups, other group types -------------------------

WIDE_CLASSES = 182


@register("wide_softmax_probs")
def q_wide_softmax_probs(spark, d):
    """P4 over 182 classes: centroids by ``vec_id % 182``."""
    items = fx.embedding_items(spark, d)
    wide = items.select((F.col("item_id") % WIDE_CLASSES).cast("int").alias("class_id"), F.col("features").alias("v"))
    classes = summaries.vector_mean(wide, ["class_id"], "v", out="vec")
    s = scoring.contrastive_scores(items.select("item_id", "features"), classes)
    return _long_scores(s.select("item_id", V.softmax("scores").alias("scores")), "prob")


def _nullable_items(spark, d):
    """FX1 with domain 3 unknown."""
    return fx.embedding_items(spark, d).withColumn("domain", F.expr("nullif(domain, 3)"))


@register("group_weights_nullable")
def q_group_weights_nullable(spark, d):
    w = sampling.group_weights(_nullable_items(spark, d))
    return w.select("item_id", "domain", F.round("weight", 9).alias("weight"))


@register("group_balanced_nullable")
def q_group_balanced_nullable(spark, d):
    s = sampling.group_balanced_sample(_nullable_items(spark, d), n=1000, seed=5)
    return s.select("draw", "item_id", "domain")


@register("group_ids_nullable")
def q_group_ids_nullable(spark, d):
    return sampling.group_ids(_nullable_items(spark, d), ["domain", "y_true"]).select("item_id", "group_id")


@register("evaluation_report_resampled")
def q_evaluation_report_resampled(spark, d):
    w = report.resampled_report(fx.order_predictions(spark, d))
    return w.select("metric", *[r6(F.col(f"`{c}`")).alias(c) for c in w.columns if c != "metric"])


@register("evaluation_report_segment")
def q_evaluation_report_segment(spark, d):
    w = report.evaluation_report(fx.order_predictions(spark, d), group="segment")
    return w.select("metric", *[r6(c).alias(c) for c in w.columns if c != "metric"])


@register("prediction_table_ordered")
def q_prediction_table_ordered(spark, d):
    """P6 as evaluation writes it: position in scan order, probabilities, labels, row count."""
    items, classes = _items_and_classes(spark, d)
    p, n = scoring.predict_table_ordered(items, classes)
    long = V.explode_vector(p, ["idx", "item_id", "y_true"], "probs", "class_id", "prob")
    return long.select("idx", "item_id", "y_true", "class_id", r6("prob").alias("prob"),
                       F.lit(n).cast("bigint").alias("n_rows"))


@register("score_pairs_blocked")
def q_score_pairs_blocked(spark, d):
    items, classes = _items_and_classes(spark, d)
    return scoring.score_pairs_blocked(items, classes).select("item_id", "class_id", r6("score").alias("score"))


@register("top_k_per_class_large_k")
def q_top_k_per_class_large_k(spark, d):
    items, classes = _items_and_classes(spark, d)
    return retrieval.top_k_per_class(scoring.predict_table(items, classes), k=5000).select("class_id", "rank", "item_id")


# --- the limited-data study ------------------------------------------------------------

STUDY_DATASET, STUDY_SWA = "fmow", ["NO"]


def _study(spark, d):
    """Grid file and report files of a study over the FX5 results, read back and joined."""
    res = fx.lineitem_grid_results(spark, d).persist()
    try:
        grid_path = scratch_path(spark, "grid")
        S3.write_grid(S3.grid_from_results(res), grid_path)
        grid = S3.read_grid(spark, grid_path)
        runs = limited_data.study_runs(grid, STUDY_DATASET, STUDY_SWA)
        values = res.groupBy("arch", "perc_ord", "lr_ord").agg(
            F.avg("id_metric").alias("id_mean"), F.avg("ood_metric").alias("ood_mean"),
            F.stddev_samp("id_metric").alias("id_std"), F.stddev_samp("ood_metric").alias("ood_std"))
        keyed = runs.select(
            "name", F.regexp_replace("arch", "_swa$", "").alias("arch"),
            F.round(F.col("perc") * 100).cast("int").alias("perc_ord"),
            F.coalesce(F.round(F.col("lr") * 100).cast("int"), F.lit(0)).alias("lr_ord"))
        cell = F.explode(F.array(*[
            F.struct(F.lit(split).alias("split"), F.lit(metric).alias("metric"),
                     (F.col(mean) * scale).alias("mean"), F.col(std).alias("std"))
            for split, mean, std in (("id_test", "id_mean", "id_std"), ("test", "ood_mean", "ood_std"))
            for metric, scale in (("acc_avg", 1.0), ("F1-macro_all", 0.5))]))
        summary = keyed.join(values, ["arch", "perc_ord", "lr_ord"]).select("name", cell.alias("c")).select("name", "c.*")
        report_path = scratch_path(spark, "reports")
        S45.write_reports(summary, report_path)
    finally:
        res.unpersist()
    reports = S45.read_reports(spark, report_path)
    return limited_data.best_settings(limited_data.study_results(grid, reports, STUDY_DATASET, STUDY_SWA))


@register("limited_data_results")
def q_limited_data_results(spark, d):
    b = _study(spark, d)
    return b.select("arch", "perc_label", "lr_label", *[r6(c).alias(c) for c in ("id_mean", "ood_mean", "id_std", "ood_std")])


@register("limited_data_curve")
def q_limited_data_curve(spark, d):
    c = selection.curve_series(_study(spark, d), error_bars=True)
    return c.select("arch", "label", r6("perc").alias("perc"), "split", r6("value").alias("value"), r6("err").alias("err"))


@register("limited_data_json")
def q_limited_data_json(spark, d):
    return S67.best_results_json(_study(spark, d), digits=6)


@register("summary_parquet_roundtrip")
def q_summary_parquet_roundtrip(spark, d):
    """S5 long form: all summaries by architecture folder, one architecture read back."""
    path = scratch_path(spark, "summaries")
    S45.write_summary_parquet(_fx5_summary(spark, d), path)
    back = S45.read_summary_parquet(spark, path).filter(F.col("arch") == "NO")
    return back.select("arch", "perc_ord", "lr_ord", r6("id_mean").alias("id_mean"), r6("ood_mean").alias("ood_mean"))


@register("grid_label_roundtrip")
def q_grid_label_roundtrip(spark, d):
    """Run names from a grid whose labels are whole numbers and numbers with exponents."""
    res = fx.lineitem_grid_results(spark, d)
    grid = res.agg(F.sort_array(F.collect_set("arch")).alias("archs"),
                   F.transform(F.sort_array(F.collect_set("perc_ord")), lambda x: x.cast("string")).alias("percs"),
                   F.transform(F.sort_array(F.collect_set("lr_ord")),
                               lambda x: F.concat((x + 1).cast("string"), F.lit("e-05"))).alias("lrs"))
    path = scratch_path(spark, "grid")
    S3.write_grid(grid, path)
    rows = experiments.run_names(experiments.expand_grid(S3.read_grid(spark, path), "train"), "fmow")
    return rows.select("name", "perc_label", "lr_label")


# --- zero-shot from prompts --------------------------------------------------------------

PROMPT_WIDTH = 64


@register("zero_shot_prompts")
def q_zero_shot_prompts(spark, d):
    """M2 from prompts: prompt dimension (S2) -> text encoder (U1) -> class vectors, and the
    documents through the same encoder."""
    encoder = inference.hashed_words_factory(PROMPT_WIDTH)
    classes = inference.encode_text(_nation_classes(spark, d), encoder).select("class_id", "vec")
    docs = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), "text", (F.col("doc_id") % 25).cast("int").alias("y_true"),
        (F.col("doc_id") % 4).cast("int").alias("domain"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    items = inference.encode_text(docs, encoder, "text", "features").drop("text")
    scored = scoring.contrastive_scores(items, classes)
    # equal scores differ in the last bits between engines: compare at 9 digits, first class wins
    pred = V.argmax_class(F.transform("scores", lambda x: F.round(x, 9))).alias("y_pred")
    preds = scored.select("split", "item_id", "y_true", "domain", pred)
    return metrics.group_accuracy(preds.filter(F.col("y_pred").isNotNull()), ["split", "domain"], "y_pred")
