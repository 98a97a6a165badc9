"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

ITEMS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
    T.StructField("y_true", T.IntegerType()),
    T.StructField("domain", T.IntegerType()),
])

CLASSES = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("class_id", T.IntegerType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("prompt", T.StringType()),
])

PREDS = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("split", T.StringType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("y_true", T.IntegerType()),
    T.StructField("y_pred", T.IntegerType()),
    T.StructField("domain", T.IntegerType()),
])

# Grid config: numbers are read as their JSON text so "1e-05" stays "1e-05".
GRID = T.StructType([
    T.StructField("archs", T.ArrayType(T.StringType())),
    T.StructField("percs", T.ArrayType(T.StringType())),
    T.StructField("lrs", T.ArrayType(T.StringType())),
])
