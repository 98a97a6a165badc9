"""Sums of vectors per key as a tree of merges: no group ever meets all partial sums of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose partial sums of one key meet in one group: two levels serve ``FAN ** 2`` tasks.
FAN = 512


def list_rows(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def list_column(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel())).cast(pa.list_(pa.float64()))


def _add(keys: int):
    """Add up one group a batch at a time: only the running sum is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, first = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            part = list_rows(b.column("_s")).sum(axis=0)
            total = part if total is None else total + part
            n += int(np.sum(b.column("_n").to_numpy()))
            if first is None:
                first = [b.column(i).slice(0, 1) for i in range(keys)]
        if first is not None:
            yield pa.RecordBatch.from_arrays([*first, list_column(total[None, :]), pa.array([n])],
                                             names=[f"k{i}" for i in range(keys)] + ["_s", "_n"])
    return run


def tree_sum(parts: DataFrame, by: list[str], fan: int | None = None, tasks: int | None = None) -> DataFrame:
    """``(by..., _s, _n)`` from partial sums ``(by..., _t, _s array<double>, _n long)``, where
    ``_t`` numbers the tasks they come from: first ``fan`` neighbouring tasks, then the rest.
    If there are known to be at most ``fan`` tasks, one level does."""
    fan = fan or FAN
    named = parts.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)],
                         F.floor(F.col("_t") / F.lit(fan)).cast("long").alias("_g"), "_s", "_n")
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    keys = [f"k{i}" for i in range(len(by))]
    tail = "_s array<double>, _n long"

    def level(df, names):
        schema = ", ".join(f"k{i} {kinds[c]}" for i, c in enumerate(names))
        return df.select(*names, "_s", "_n").groupBy(*names).applyInArrow(
            _add(len(names)), f"{schema}, {tail}" if schema else tail)

    if tasks is not None and tasks <= fan:
        first = named.drop("_g")
    else:
        first = level(named, [*keys, "_g"]).drop(f"k{len(keys)}")
    out = level(first, keys)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "_s", "_n")
