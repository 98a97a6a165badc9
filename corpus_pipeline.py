"""A training corpus from ``documents``: toxicity filter, exact and near deduplication,
mixing to target weights, best-fit packing.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and works on all rows
its predecessor kept. All but the last return rows with the columns of ``docs``; the last
returns the packed pieces. :func:`run` writes each stage's result as Parquet in the shared
checkpoint folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftlab.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from shiftlab.llm.common import saved, table
from shiftlab.session import prepare

#: Stage 1: documents that score this or more go.
TOXIC_LIMIT = 0.5
#: Stage 3: words of a shingle, and the share of shingles that links two documents.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Stage 4: share of the tokens that a draw without repeats must hold; otherwise documents of
#: rare cells are repeated in a draw of as many tokens as there are.
LEAST_SHARE = 0.75
#: Stage 5: ids of a sequence, and the id that ends a document.
SEQUENCE_IDS, END_ID = 4096, 1
#: What a packing task holds: its executor still has the memory of the stages before.
SLICE_BYTES, WORDS = 1 << 20, 100_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the grammar does not reject; it is learnt from the labelled ones of ``docs``.

    Null and empty texts have no clauses and stay; repeated rows and null ids are judged each.
    An empty table stays empty.
    """
    prepare(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, TOXIC_LIMIT)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id.

    A null text counts as an empty one; of rows equal in text and id one stays. An empty table
    stays empty.
    """
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id.

    Null and empty texts are like nothing else and stay, as do rows without an id; rows of one
    id count as one document. An empty table stays empty.
    """
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs, width=SHINGLE_WORDS, share=SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw in which sources, languages and topics have their target shares.

    Null sources and languages are values of their own, null texts have one token; rows of one id
    are drawn alike. An empty table stays empty.
    """
    prepare(spark)
    return mixing.sample_documents(docs, least=LEAST_SHARE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is its end id alone; repeated rows are packed each; ties take their
    places in any order. An empty table gives no pieces.
    """
    prepare(spark)
    return packing.pack_documents(docs, capacity=SEQUENCE_IDS, end_id=END_ID, slice_bytes=SLICE_BYTES, words=WORDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learnt scores, sketches and tokenizers have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
