"""A bounded sample of labelled documents to fit a small model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import maybe_in


def held_out(id_col: str, parts: int, part: int):
    """Whether the row's id falls in the fold that is never learnt from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], rows: int,
           id_col: str = "doc_id", text_col: str = "text", longest: int | None = None) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out ``fold``,
    those with the smallest hashes of their ids; ``longest`` leaves out longer texts
    (in characters). Rows whose label or id is null are not used; the id is used for the
    choice alone."""
    known = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
             .where(~held_out("_id", *fold)))
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if longest:
        text = text.where(F.length("text") <= longest)
    chosen = known.orderBy(F.xxhash64(F.col("_id"), F.lit(29)), "_id", "label").limit(rows)
    return (maybe_in(text, F.col("_id"), chosen.select("_id"))
            .join(F.broadcast(chosen), "_id").select("text", "label"))   # at most ``rows`` rows
