"""Item tables and F1 single-domain datasets."""

from __future__ import annotations

import warnings
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab import SPLITS
from shiftlab.operators.sampling import domain_filter
from shiftlab.sources.schemas import ITEMS


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write an item table partitioned by dataset and split (split scans prune folders)."""
    items.write.mode(mode).partitionBy("dataset", "split").parquet(path)


def base_dataset(name: str) -> tuple[str, int | None]:
    """``iwildcam_0`` -> (``iwildcam``, 0): the ``_0`` variant trains on group 0 only."""
    if name.endswith("_0"):
        return name[:-2], 0
    return name, None


def read_items(spark: SparkSession, source, dataset: str | None = None,
               splits: Sequence[str] = SPLITS, check: bool = True) -> DataFrame:
    """Scan one dataset's items, keeping the named splits.

    ``source`` is a path (read with the declared schema; split and dataset
    filters prune partitions) or a DataFrame. With ``check``: an unknown
    dataset raises, a missing train split raises, a missing evaluation split
    warns and contributes no rows. The check reads only the distinct split
    values of the dataset.
    """
    df = spark.read.schema(ITEMS).parquet(source) if isinstance(source, str) else source
    group_id = None
    if dataset is not None:
        name, group_id = base_dataset(dataset)
        df = df.filter(F.col("dataset") == name)
    splits = list(splits)
    if check:
        present = {r[0] for r in df.select("split").distinct().collect()}
        if dataset is not None and not present:
            raise ValueError(f"the items hold no dataset named {dataset!r}")
        for s in splits:
            if s not in present:
                if s == "train":
                    raise ValueError(f"split {s} missing from dataset {dataset}")
                warnings.warn(f"split {s} missing; it yields no rows")
    out = df.filter(F.col("split").isin(splits))
    return domain_filter(out, group_id)
