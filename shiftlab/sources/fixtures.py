"""Proxy item tables built from the driver's generic tables.

Each function is a plain projection / join / aggregate of the named parquet
tables, so the work grows with the data. The same definitions are written in
DuckDB SQL for the oracle (``shiftlab.oracle``).
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.sources.tables import read_table, spread


def _split_by_block(block: F.Column) -> F.Column:
    """In-distribution split from a block number: 8 -> id_val, 9 -> id_test, else train."""
    return (F.when(block == 8, "id_val")
            .when(block == 9, "id_test")
            .otherwise("train"))


def embedding_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """FX1: ``embeddings`` as an item table with 8 domains and 5 splits."""
    return embedding_items_from(read_table(spark, data_dir, "embeddings"))


def embedding_items_from(e: DataFrame) -> DataFrame:
    """FX1 over a given embeddings frame (batch or stream)."""
    domain = (F.col("vec_id") % 8).cast("int")
    block = F.expr("vec_id div 8") % 10
    split = (F.when(domain == 5, "val")
             .when(domain.isin(6, 7), "test")
             .otherwise(_split_by_block(block)))
    return e.select(
        F.lit("embeddings").alias("dataset"),
        split.alias("split"),
        F.col("vec_id").alias("item_id"),
        F.col("embedding").alias("features"),
        F.col("label").alias("y_true"),
        domain.alias("domain"),
    )


def order_predictions(spark: SparkSession, data_dir: str, runs: int = 3) -> DataFrame:
    """FX3: orders x customer x nation as a prediction table over ``runs`` runs.

    Every order is one item; the run number is generated per row (explode), so
    the table has ``runs`` rows per order without a join.
    """
    return order_predictions_from(read_table(spark, data_dir, "orders"), spark, data_dir, runs)


def order_predictions_from(orders: DataFrame, spark: SparkSession, data_dir: str,
                           runs: int = 3) -> DataFrame:
    """FX3 over a given orders frame (batch or stream); customer and nation are static."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, data_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, data_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(F.broadcast(n), c.c_nationkey == n.n_nationkey))
    j = j.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    y_true = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    hit = (F.col("o_orderkey") * 7 + F.col("o_custkey") * 3 + F.col("run") * 11) % 10 < 6
    y_pred = F.when(hit, y_true).otherwise(((F.col("o_custkey") + F.col("run")) % 5).cast("int"))
    year = F.year("o_orderdate")
    split = (F.when(year <= 1997, _split_by_block(F.col("o_orderkey") % 10))
             .when(year <= 1999, "val")
             .otherwise("test"))
    return j.select(
        F.col("run").cast("int").alias("run"),
        split.alias("split"),
        F.col("o_orderkey").alias("item_id"),
        y_true.alias("y_true"),
        y_pred.alias("y_pred"),
        F.col("n_regionkey").cast("int").alias("domain"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("int").alias("nation"),
    )


def event_epoch_log(spark: SparkSession, data_dir: str) -> DataFrame:
    """FX4: ``events`` as per-run epoch metrics (run = user_id % 3, epoch = day - 1)."""
    ev = read_table(spark, data_dir, "events")
    return (ev.groupBy((F.col("user_id") % 3).cast("int").alias("run"),
                       (F.dayofmonth("ts") - 1).cast("int").alias("epoch"))
              .agg((F.sum(F.round(F.col("value") * 100).cast("bigint"))
                    / F.count(F.lit(1)) / 10000).alias("metric")))


def lineitem_grid_results(spark: SparkSession, data_dir: str) -> DataFrame:
    """FX5: ``lineitem`` as grid results: one row per (arch, fraction, lr, run).

    ``perc_ord`` 0 is the zero-shot fraction. Integer sums and one division keep
    the metrics bit-identical across engines.
    """
    li = read_table(spark, data_dir, "lineitem")
    return (li.groupBy(
                F.concat("l_returnflag", "l_linestatus").alias("arch"),
                F.round(F.col("l_discount") * 100).cast("int").alias("perc_ord"),
                F.round(F.col("l_tax") * 100).cast("int").alias("lr_ord"),
                (F.col("l_linenumber") % 3).cast("int").alias("run"))
              .agg((F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1)) / 100)
                   .alias("id_metric"),
                   (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
                    / F.count(F.lit(1)) / 100000000).alias("ood_metric")))


def lineitem_present_artifacts(spark: SparkSession, data_dir: str) -> DataFrame:
    """FX7 present side: grid keys that have a stored artifact."""
    li = read_table(spark, data_dir, "lineitem").filter(
        (F.col("l_quantity") >= 45) & (F.col("l_suppkey") % 4 == 0))
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("arch"),
        F.round(F.col("l_discount") * 100).cast("int").alias("perc_ord"),
        F.round(F.col("l_tax") * 100).cast("int").alias("lr_ord"),
        (F.col("l_linenumber") % 3).cast("int").alias("run")).distinct()


def embedding_param_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    """FX6: ``embeddings`` as per-epoch parameter vectors (param = label)."""
    e = read_table(spark, data_dir, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("param"),
        (F.expr("vec_id div 10") % 30).cast("int").alias("epoch"),
        F.col("embedding").alias("v"),
        F.col("vec_id"),
    )


def embedding_pixels(spark: SparkSession, data_dir: str) -> DataFrame:
    """FX8: the whole embedding as a flattened 3-channel image (channel = position mod 3)."""
    e = read_table(spark, data_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"),
                    F.col("embedding").alias("pixel"))


# The four document languages in label order.
DOC_LANGS = ["en", "fr", "de", "es"]


def document_items(spark: SparkSession, data_dir: str, num_features: int = 256) -> DataFrame:
    """FX9: ``documents`` as learnable items: language label, hashed token features.

    Features are hashed term counts of all lower-cased whitespace tokens of
    the whole text (a fixed-width featuriser standing in for a frozen
    encoder); labels are the language, domains the source number.
    """
    d = spread(read_table(spark, data_dir, "documents").select("doc_id", "text", "lang", "source"))
    y = F.array_position(F.array(*[F.lit(x) for x in DOC_LANGS]), F.col("lang")).cast("int") - 1
    domain = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    split = (F.when(domain.between(14, 16), "val")
             .when(domain.between(17, 19), "test")
             .otherwise(_split_by_block(F.col("doc_id") % 10)))
    toks = F.split(F.trim(F.lower(F.col("text"))), r"\s+")
    base = d.select(
        F.lit("documents").alias("dataset"), split.alias("split"),
        F.col("doc_id").alias("item_id"), toks.alias("tokens"),
        y.alias("y_true"), domain.alias("domain"))
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    out = tf.transform(base)
    return out.select("dataset", "split", "item_id",
                      vector_to_array("tf", "float32").alias("features"),
                      "y_true", "domain")
