
from shiftlab.operators import selection


def _log(spark, rows):
    return spark.createDataFrame(rows, "run int, epoch int, metric double")


def test_best_checkpoint_rules(spark):
    nan = float("nan")
    log = _log(spark, [
        (0, 0, 0.2), (0, 4, 0.5), (0, 9, 0.5), (0, 14, 0.3), (0, 3, 0.99),   # epoch 3 not evaluated
        (1, 0, -0.1), (1, 4, 0.0),                                          # all <= 0: none
        (2, 0, nan), (2, 4, 0.1), (2, 9, nan),                               # NaN never wins
    ])
    got = {r.run: (r.best_epoch, r.best_metric, r.checkpoint_epoch)
           for r in selection.best_checkpoint(log, eval_freq=5).collect()}
    assert got == {0: (4, 0.5, 5), 2: (4, 0.1, 5)}
    flags = {(r.run, r.epoch): r.is_best for r in selection.checkpoint_flags(log, 5).collect()}
    assert flags[(0, 0)] and flags[(0, 4)] and not flags[(0, 9)] and not flags[(0, 14)]
    assert not flags[(1, 0)] and not flags[(1, 4)]
    assert not flags[(2, 0)] and flags[(2, 4)] and not flags[(2, 9)]
    assert (0, 3) not in flags


def _res(spark, rows):
    return spark.createDataFrame(rows, "arch string, perc_ord int, lr_ord int, id_mean double, "
                                       "ood_mean double, id_std double, ood_std double")


def test_best_lr_ties_nonpositive_nan_zero_shot(spark):
    nan = float("nan")
    r = _res(spark, [
        ("a", 1, 0, 0.1, 0.5, 0.0, 0.0), ("a", 1, 1, 0.2, 0.5, 0.0, 0.0), ("a", 1, 2, 0.3, 0.4, 0.0, 0.0),
        ("a", 2, 0, 0.1, -0.5, 0.0, 0.0), ("a", 2, 1, 0.1, 0.0, 0.0, 0.0),
        ("a", 3, 0, 0.1, nan, 0.0, 0.0), ("a", 3, 1, 0.1, 0.2, 0.0, 0.0),
        ("a", 0, 0, 0.9, -1.0, 0.0, 0.0),
    ])
    got = {(x.arch, x.perc_ord): (x.lr_ord, x.id_mean) for x in selection.best_lr(r).collect()}
    assert got == {("a", 1): (0, 0.1), ("a", 3): (1, 0.1), ("a", 0): (0, 0.9)}


def test_curve_series_labels_and_errors(spark):
    b = spark.createDataFrame([("vitb32_clip_linearprob", 0.1, 0.5, 0.4, 0.01, 0.02)],
                              "arch string, perc double, id_mean double, ood_mean double, id_std double, ood_std double")
    rows = {r.split: r for r in selection.curve_series(b).collect()}
    assert rows["ID Test"].label == "CLIP ViT-B/32 Linear Probe" and rows["OOD Test"].err == 0.02
    no_err = selection.curve_series(b, error_bars=False).collect()
    assert all(r.err is None for r in no_err)


def test_best_lr_zero_shot_only(spark):
    r = _res(spark, [("a", 0, 0, 0.3, -0.2, 0.0, 0.0)])
    rows = selection.best_lr(r).collect()
    assert [(x.arch, x.perc_ord, x.lr_ord, x.ood_mean) for x in rows] == [("a", 0, 0, -0.2)]
