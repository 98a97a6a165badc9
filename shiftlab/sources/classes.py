"""Class-prompt dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prompt prefix per dataset.
TEXT_PREFIX = {
    "camelyon17": "this is a photo of ",
    "fmow": "a centered satellite photo of ",
    "iwildcam": "this is a photo of ",
}


def prompt_prefix(dataset: str) -> str:
    name = dataset.lower().replace("_0", "")
    if name not in TEXT_PREFIX:
        raise ValueError(f"no prompt prefix is known for {dataset!r}")
    return TEXT_PREFIX[name]


def class_prompts(vocab: DataFrame, dataset: str, id_col: str = "class_id",
                  name_col: str = "class_name") -> DataFrame:
    """One row per class: id, name and ``prefix + name``.

    Keyed on id: class names need not be unique.
    """
    prefix = prompt_prefix(dataset)
    return vocab.select(
        F.lit(dataset.lower().replace("_0", "")).alias("dataset"),
        F.col(id_col).cast("int").alias("class_id"),
        F.col(name_col).alias("class_name"),
        F.concat(F.lit(prefix), F.col(name_col)).alias("prompt"))


def class_prompts_from_list(spark, names: list[str], dataset: str) -> DataFrame:
    """S2 from a Python list: the class id is the list position."""
    arr = spark.createDataFrame([(names,)], "names array<string>")
    vocab = arr.select(F.posexplode("names").alias("class_id", "class_name"))
    return class_prompts(vocab, dataset)
