"""A bitmap of hashed keys for use inside Python tasks, with a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits per key, and the most bits of a filter (64 MiB): this is what goes through the
#: driver and to every executor. Beyond four million keys per MiB more keys pass that are not
#: members, so whatever passes is counted or joined exactly afterwards.
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29
_ROW_BITS = 15


class KeyFilter:
    """Whether 64-bit keys (evenly spread hashes) may be members: true for all that are."""

    def __init__(self, broadcast):
        self._broadcast = broadcast

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        bits = self._broadcast.value
        p = keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
        return (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0


def key_filter(keys: DataFrame, n: int) -> KeyFilter:
    """A filter of the ``n`` values (long, not null) of the one column of ``keys``."""
    size = LEAST_BITS
    while size < min(n * BITS_PER_KEY, MOST_BITS):
        size *= 2
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(size - 1).cast("long"))
    rows = (keys.select(place.alias("p")).groupBy(F.shiftright("p", _ROW_BITS).alias("row"))
            .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << _ROW_BITS) - 1)).alias("bits")).collect())
    bits = np.zeros(size // 8, np.uint8)
    step = 1 << (_ROW_BITS - 3)
    for r in rows:                                                      # at most MOST_BITS / 2 ** 15 rows
        bits[r["row"] * step:(r["row"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return KeyFilter(keys.sparkSession.sparkContext.broadcast(bits))
