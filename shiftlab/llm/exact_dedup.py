"""Exact deduplication by progressive refinement.

Texts are grouped by length, then by a hash of their first bytes, then by a hash of the
whole text; each step only looks at rows whose group of the step before has more than
one. Which lengths and prefixes survive is passed to the next scan as a bitmap of fixed
size (:func:`common.maybe_in`), so no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import flag_maybe_in, fresh, maybe_in, saved

PREFIX_BYTES = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row per group of two or more rows with identical texts: ``text_sha256``,
    ``keep_id`` (the largest id), ``group_size``.

    A null text counts as empty. Repeated rows count each. Ids that are null are passed
    over unless the group has no other. Texts are compared by length and SHA-256.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = F.octet_length("t")
    prefix = F.xxhash64(n, F.substring(F.encode("t", "UTF-8"), 1, prefix_bytes))
    lengths = rows.groupBy(n.alias("n")).count().where("count > 1").select("n")
    same_length = maybe_in(rows, n, lengths)
    prefixes = same_length.groupBy(prefix.alias("p")).count().where("count > 1").select("p")
    same_prefix = maybe_in(rows, prefix, prefixes)
    return (same_prefix.select("id", n.alias("n"), F.sha2("t", 256).alias("text_sha256"))
            .groupBy("n", "text_sha256")
            .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1").select("text_sha256", "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row per input row, with its id column and ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    ``kept`` is true where the row's id is its group's ``keep_id`` (repeated rows of the
    kept id are all marked; :func:`drop_exact_duplicates` leaves one). A row alone in its
    group keeps itself. An empty table gives no rows; further columns are ignored.
    """
    groups = exact_groups(docs, id_col, text_col, prefix_bytes)
    rows = docs.select(F.col(id_col).alias("_id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    out = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """The rows of ``docs``, one per text: the one with the largest id. All columns stay.

    Of repeated rows with the kept id and text one stays. An empty table stays empty.
    Only rows whose text may be in a group are shuffled; the others pass straight through.
    """
    cols = docs.columns
    sha, keep, flag = fresh(docs, "_sha", "_keep", "_flag")
    groups = saved(exact_groups(docs, id_col, text_col, prefix_bytes), "exact").select(
        F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    hashed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    flagged = flag_maybe_in(hashed, F.col(sha), groups.select(sha), flag)
    some = flagged.where(flag).drop(flag)
    kept = some.join(groups, sha).where(F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([sha])
    return (flagged.where(~F.col(flag)).select(*cols)
            .unionByName(some.join(groups, sha, "left_anti").select(*cols)).unionByName(kept.select(*cols)))
