"""Experiment grids, artifacts and result lookup."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("arch", "perc_ord", "lr_ord")


def expand_grid(grid: DataFrame, mode: str = "train") -> DataFrame:
    """Every (arch, fraction, lr) of a grid row ``archs, percs, lrs`` (arrays).

    ``train`` skips fraction 0; ``test`` adds one zero-shot row per arch
    (fraction 0, no lr); ``all`` is the full product. Positions in the arrays are kept as ``*_ord`` (config
    order breaks ties in T5). Arrays are exploded inside the row: no join.
    The ``percs``/``lrs`` arrays may hold numbers or their text; a text label
    column is derived either way.
    """
    if mode not in ("train", "test", "all"):
        raise ValueError("mode must be 'train', 'test' or 'all'")
    a = grid.select(F.posexplode("archs").alias("arch_ord", "arch"), "percs", "lrs")
    p = a.select("arch_ord", "arch", F.posexplode("percs").alias("perc_ord", "perc_label"), "lrs")
    p = p.withColumn("perc", F.col("perc_label").cast("double")) \
         .withColumn("perc_label", F.col("perc_label").cast("string"))
    trained = ((p if mode == "all" else p.filter(F.col("perc") > 0))
                .select("arch_ord", "arch", "perc_ord", "perc", "perc_label",
                        F.posexplode("lrs").alias("lr_ord", "lr_label"))
                .withColumn("lr", F.col("lr_label").cast("double"))
                .withColumn("lr_label", F.col("lr_label").cast("string")))
    cols = ["arch_ord", "arch", "perc_ord", "perc", "perc_label", "lr_ord", "lr", "lr_label"]
    trained = trained.select(*cols)
    if mode in ("train", "all"):
        return trained
    zero = (p.filter(F.col("perc") == 0)
             .groupBy("arch_ord", "arch").agg(F.min("perc_ord").alias("perc_ord"))
             .select("arch_ord", "arch", "perc_ord", F.lit(0.0).alias("perc"),
                     F.lit("0").alias("perc_label"), F.lit(None).cast("int").alias("lr_ord"),
                     F.lit(None).cast("double").alias("lr"), F.lit(None).cast("string").alias("lr_label")))
    return trained.unionByName(zero)


def run_names(grid_rows: DataFrame, dataset: str, swa: bool = False) -> DataFrame:
    """Derived experiment names, as the result files are named; ``swa``: of the weight-averaged
    models, whose names end in ``_swa`` (a zero-shot row has none)."""
    zs = F.col("perc") == 0
    trained = F.format_string("%s_%s_perctrain_%s_lr_%s" + ("_swa" if swa else ""), F.lit(dataset), F.col("arch"),
                              F.col("perc_label"), F.col("lr_label"))
    if swa:
        return grid_rows.filter(~zs).withColumn("name", trained)
    return grid_rows.withColumn("name", F.when(zs, F.format_string("%s_%s_zeroshot", F.lit(dataset), F.col("arch")))
                                .otherwise(trained))


def expected_checkpoints(grid_rows: DataFrame, n_runs: int, kinds: Sequence[str] = ("best",)) -> DataFrame:
    """The model files that testing needs: run 1..n of each trained cell, per kind
    (``best``, ``swa``). Zero-shot rows need none."""
    trained = grid_rows.filter(F.col("perc") != 0)
    return (trained.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(int(n_runs)))))
                   .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))))


def arch_filename(arch) -> F.Column:
    """Architecture name as used in artifact file names (``resnet50`` -> ``RN50``, ``vitb32`` -> ``ViTB32``)."""
    c = F.col(arch) if isinstance(arch, str) else arch
    return F.replace(F.replace(c, F.lit("resnet50"), F.lit("RN50")), F.lit("vitb32"), F.lit("ViTB32"))


def run_paths(grid_rows: DataFrame, dataset: str, model_dir: str, log_dir: str) -> DataFrame:
    """Model and log folders of each trained grid cell: ``<dir>/<dataset>/perc_train_<p>/lr_<lr>``
    (NULL for a zero-shot row, which has no model)."""
    sub = F.when(F.col("lr_label").isNotNull(), F.format_string(
        "/%s/perc_train_%s/lr_%s", F.lit(dataset), F.col("perc_label"), F.col("lr_label")))
    return (grid_rows.withColumn("model_path", F.concat(F.lit(model_dir), sub))
                     .withColumn("log_path", F.concat(F.lit(log_dir), sub))
                     .withColumn("arch_file", arch_filename("arch")))


def missing_artifacts(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected artifacts with no present counterpart (left anti join)."""
    have = present.select(*keys).distinct()
    cond = reduce(lambda a, b: a & b, [expected[k].eqNullSafe(have[k]) for k in keys])
    return expected.join(have, cond, "left_anti")


def require_artifacts(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> None:
    """Raise when anything expected is missing (the check before a report)."""
    miss = missing_artifacts(expected, present, keys).limit(5).collect()
    if miss:
        raise FileNotFoundError(f"missing artifacts, first ones: {[r.asDict() for r in miss]}")


def join_results(grid_rows: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS,
                 swa_results: DataFrame | None = None, swa_arch: str | None = None,
                 require: bool = False) -> DataFrame:
    """Each grid cell with its result row; an SWA result set joins as arch ``<arch>_swa``.

    A cell without a result stays, with NULL metrics; with ``require`` it raises (J4).

    The SWA rows are tagged and unioned before the join, so it stays one
    equi-join on the experiment key (the grid is the small side).
    """
    res = results
    if swa_results is not None:
        tag = F.concat(F.col("arch"), F.lit("_swa"))
        swa = swa_results.withColumn("arch", tag)
        if swa_arch is not None:
            swa = swa.filter(F.col("arch") == F.lit(swa_arch + "_swa"))
        res = res.unionByName(swa)
    if require:
        require_artifacts(grid_rows.select(*keys), res, keys)
    cond = reduce(lambda a, b: a & b, [grid_rows[k].eqNullSafe(res[k]) for k in keys])   # zero-shot: no lr
    return grid_rows.join(res, cond, "left").drop(*[res[k] for k in keys])
