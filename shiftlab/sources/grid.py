"""S3: experiment grid config (JSON with arrays archs, percs, lrs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.sources.schemas import GRID


# The default limited-data grid (architectures, training fractions, learning rates).
DEFAULT_ARCHS = ["vitb32_pretrained_finetune", "vitb32_pretrained_linearprob",
                 "vitb32_clip_finetune", "vitb32_clip_linearprob"]
DEFAULT_PERCS = [0, 0.03, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 1]
DEFAULT_LRS = [1e-2, 1e-3, 1e-4, 1e-5]


def grid_from_lists(spark: SparkSession, archs=DEFAULT_ARCHS, percs=DEFAULT_PERCS,
                    lrs=DEFAULT_LRS) -> DataFrame:
    """A one-row grid from Python lists; numbers keep their Python text (``1e-05``)."""
    return spark.createDataFrame([(list(archs), [str(p) for p in percs], [str(x) for x in lrs])],
                                 "archs array<string>, percs array<string>, lrs array<string>")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """One row ``archs, percs, lrs``; numbers are kept as their JSON text, order is kept."""
    return (spark.read.schema(GRID).option("multiLine", True)
                 .option("primitivesAsString", True).json(path))


def write_grid(grid: DataFrame, path: str) -> None:
    """Write a one-row grid as JSON. A label's own text is the JSON number, so reading it
    back gives the same label (``1e-05``, ``1``), which names the run's files."""
    def numbers(c):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
    line = F.concat(F.lit('{"archs":'), F.to_json("archs"), F.lit(',"percs":'), numbers("percs"),
                    F.lit(',"lrs":'), numbers("lrs"), F.lit("}"))
    grid.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def grid_from_results(results: DataFrame, arch: str = "arch", perc_ord: str = "perc_ord",
                      lr_ord: str = "lr_ord", perc_scale: float = 100.0,
                      lr_scale: float = 100.0) -> DataFrame:
    """A grid row from the distinct keys of a result table.

    One aggregation; ``collect_set`` de-duplicates inside each task, so each
    array carries at most the cardinality of its (small) grid dimension.
    """
    def scaled(col, scale):
        return F.transform(F.sort_array(F.collect_set(F.col(col))),
                           lambda x: (x / F.lit(scale)).cast("string"))
    return results.agg(F.sort_array(F.collect_set(F.col(arch))).alias("archs"),
                       scaled(perc_ord, perc_scale).alias("percs"),
                       scaled(lr_ord, lr_scale).alias("lrs"))
