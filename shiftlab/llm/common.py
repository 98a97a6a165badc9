"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.session import scratch_path

#: log2 of the bits of a key filter: at most 2048 rows of 4 KiB (8 MiB) are broadcast,
#: whatever the size of the input.
FILTER_BITS = 26
_ROW_BITS = 15


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back:
    later steps neither recompute it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS).cast("long"))


def flag_maybe_in(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column ``flag``: whether ``key`` may be among the values of the
    one column of ``keys``. It is true for all that are, and for a few that are not.

    The keys become one bitmap of ``2 ** FILTER_BITS`` bits, so what is broadcast has a
    fixed bound. Beyond some ten million keys the bitmap fills up and flags more rows,
    so an exact join or group by of the flagged rows has to follow. Null keys are false.
    """
    k = keys.columns[0]
    row, bits, own = fresh(df, "_filter_row", "_filter_bits", "_filter_own")
    bitmap = (keys.where(F.col(k).isNotNull()).select(_place(F.col(k)).alias("p"))
              .groupBy(F.shiftright("p", _ROW_BITS).alias(row))
              .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << _ROW_BITS) - 1)).alias(bits)))
    p = _place(key)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(p.bitwiseAND((1 << _ROW_BITS) - 1), 3) + 1).cast("int"),
                                    F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, p.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return (df.withColumn(own, F.when(key.isNotNull(), F.shiftright(p, _ROW_BITS)))
            .join(F.broadcast(bitmap), F.col(own) == F.col(row), "left")
            .select(*df.columns, hit.alias(flag)))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` that :func:`flag_maybe_in` flags."""
    flag, = fresh(df, "_filter_flag")
    return flag_maybe_in(df, key, keys, flag).where(flag).select(*df.columns)


def release_memory() -> None:
    """Give freed memory back to the system: worker processes outlive their tasks, and two
    of them share an executor's memory with the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over batches that releases its memory when its task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (id, component) for every vertex of an edge,
    the component being its smallest vertex. Large-star and small-star steps in turn
    (Kiveris et al., 2014) until nothing changes; every step is written to the shared
    folder. A vertex with very many edges is only ever aggregated and joined, never
    gathered."""
    e = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = saved(small, "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    tops = e.select(F.col("v").alias("id")).distinct()
    return (e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
            .unionByName(tops.select("id", F.col("id").alias("component"))))


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
