"""The k highest rows of every class for large k: find the k-th value, then move what reaches it.

Values are compared as 64-bit numbers in the same order, 16 bits at a time from the top: a
scan counts, per class, the values that share the bits known so far by their next 16 bits, and
the counts tell in which bin the k-th value lies. A class is done when its bin holds at most
``SLACK`` rows more than are needed. If all 64 bits are equal there (ties), the same goes on
with the keys, from the smallest. A scan sends one count per class and non-empty bin and task;
only rows that reach a class's threshold are ever sent themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.operators.sampling import with_index
from shiftlab.sources.tables import written

#: Rows of a class that may be sent although they are not among its k highest.
SLACK = 1000
BITS = 16


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order: NaN highest, compared at 12 decimals."""
    v = np.where(np.isnan(values), np.inf, np.round(values, 12)) + 0.0           # -0.0 becomes 0.0
    u = np.ascontiguousarray(v).view(np.uint64)
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def _places(keys: np.ndarray) -> np.ndarray:
    """Integer keys as unsigned numbers that fall as the keys rise: the smaller key comes first."""
    return ~(keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def _shared(u: np.ndarray, known: int, bits: int) -> np.ndarray:
    """Whether the highest ``known`` bits are ``bits``."""
    return np.ones(len(u), bool) if not known else u >> np.uint64(64 - known) == np.uint64(bits)


def _higher(u: np.ndarray, known: int, bits: int) -> np.ndarray:
    return np.zeros(len(u), bool) if not known else u >> np.uint64(64 - known) > np.uint64(bits)


class Threshold:
    """What is known of a class's k-th row: its highest ``known`` bits (the key's bits follow
    the value's), and how many rows with these bits are needed."""

    __slots__ = ("known", "bits", "need", "done")

    def __init__(self, need: int):
        self.known, self.bits, self.need, self.done = 0, 0, need, False

    def split(self) -> tuple[tuple[int, int], tuple[int, int] | None]:
        """Known bits of the value, and of the key (None: no tie is cut)."""
        if self.known <= 64:
            return (self.known, self.bits), None
        k = self.known - 64
        return (64, self.bits >> k), (k, self.bits & ((1 << k) - 1))

    def open_rows(self, u: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose known bits agree, and the number their next bits are taken from."""
        (known, bits), key = self.split()
        at = _shared(u, known, bits)
        if known < 64:
            return at, u
        w = _places(keys)
        return at & _shared(w, *(key or (0, 0))), w

    def reached(self, u: np.ndarray, keys: np.ndarray) -> np.ndarray:
        (known, bits), key = self.split()
        at = _shared(u, known, bits)
        if key is not None:
            w = _places(keys)
            at &= _shared(w, *key) | _higher(w, *key)
        return at | _higher(u, known, bits)


def _parts(frames, by: list[str], probs_col: str):
    """(group of ``by``, its rows, their matrix of probabilities)."""
    for f in frames:
        f = f[f[probs_col].notna()]
        for part, g in (f.groupby(by, dropna=False, sort=False) if by else [((), f)]):
            if len(g):
                part = tuple(None if pd.isna(p) else p for p in part)
                yield part, g, np.stack(g[probs_col].to_numpy()).astype(np.float64)


def _count(by, key, probs_col, thresholds):
    def run(frames):
        total: dict[tuple, np.ndarray] = {}
        known = thresholds.value
        for part, g, p in _parts(frames, by, probs_col):
            keys = g[key].to_numpy()
            for c in range(p.shape[1]):
                t = known.get((part, c)) if known is not None else Threshold(0)
                if t is None or t.done:
                    continue
                u = ordered(p[:, c])
                at, of = t.open_rows(u, keys)
                shift = 64 - BITS - t.known % 64
                bins, n = np.unique(of[at] >> np.uint64(shift) & np.uint64((1 << BITS) - 1), return_counts=True)
                counts = total.setdefault((part, c), np.zeros(1 << BITS, np.int64))
                counts[bins.astype(np.int64)] += n
        for (part, c), counts in total.items():
            bins = np.flatnonzero(counts)
            yield pd.DataFrame({**{b: [v] * len(bins) for b, v in zip(by, part)}, "class_id": c, "bin": bins,
                                "n": counts[bins]})
    return run


def find_thresholds(rows: DataFrame, k: int, by: Sequence[str] = (), key: str = "item_id",
                    probs_col: str = "probs") -> dict[tuple, Threshold]:
    """The threshold of every (group, class): one scan of ``rows`` per 16 bits."""
    by = list(by)
    sc = rows.sparkSession.sparkContext
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema.fields)
    whole = rows.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    found: dict[tuple, Threshold] = {}
    while True:
        shared = sc.broadcast(found or None)
        counts = rows.mapInPandas(_count(by, key, probs_col, shared), f"{kinds}class_id int, bin int, n long")
        counts = counts.groupBy(*by, "class_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy(*by, "class_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        need = F.lit(k)
        if found:
            # one row per open class
            needs = rows.sparkSession.createDataFrame(
                [(*part, c, t.need) for (part, c), t in found.items() if not t.done], f"{kinds}class_id int, need long")
            on = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "class_id"]])
            counts = counts.alias("a").join(F.broadcast(needs).alias("b"), on).select("a.*", "b.need")
            need = F.col("need")
        counts = counts.withColumn("upto", F.sum("n").over(down))
        # the bin of the k-th row; a class with fewer rows has none
        at = counts.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).collect()
        shared.unpersist()
        first = not found
        for r in at:                                                              # one row per class
            name = (tuple(r[b] for b in by), r["class_id"])
            t = found.setdefault(name, Threshold(k))
            t.need -= r["upto"] - r["n"]
            t.bits, t.known = t.bits << BITS | r["bin"], t.known + BITS
            t.done = r["n"] - t.need <= SLACK or t.known == 128 or (t.known == 64 and not whole)
        if not found or (not first and not at) or all(t.done for t in found.values()):
            return found


def _reaching(by, key, probs_col, thresholds):
    def run(frames):
        known = thresholds.value
        for part, g, p in _parts(frames, by, probs_col):
            keys, labels = g[key].to_numpy(), g["y_true"].to_numpy(dtype=np.int64)
            for c in range(p.shape[1]):
                t = known.get((part, c))
                at = np.arange(len(g)) if t is None else np.flatnonzero(t.reached(ordered(p[:, c]), keys))
                if len(at):
                    yield pd.DataFrame({**{b: [v] * len(at) for b, v in zip(by, part)}, "class_id": c,
                                        key: keys[at], "y_true": labels[at], "prob": p[at, c]})
    return run


def rows_reaching(rows: DataFrame, thresholds: dict[tuple, Threshold], by: Sequence[str] = (), key: str = "item_id",
                  probs_col: str = "probs") -> DataFrame:
    """``(by..., class_id, key, y_true, prob)`` of all rows at or above their class's threshold."""
    by = list(by)
    shared = rows.sparkSession.sparkContext.broadcast(thresholds)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by, key).schema.fields)
    out = rows.mapInPandas(_reaching(by, key, probs_col, shared), f"{kinds}, class_id int, y_true int, prob double")
    return out.select(*by, key, "class_id", "y_true", F.coalesce("prob", F.lit(float("nan"))).alias("prob"))


def select_per_class(probs: DataFrame, k: int, by: Sequence[str] = (), key: str = "item_id",
                     probs_col: str = "probs") -> DataFrame:
    """The ``k`` highest rows of every class with their rank, for a ``k`` too large for a task.

    The probabilities are written once and scanned once per 16 bits; at most ``k + SLACK``
    rows of a class are moved. Ranks come from the distributed dense index over (class,
    value, key), so no class is sorted in one task.
    """
    by = list(by)
    rows = written(probs.select(*by, key, "y_true", probs_col), "class-probabilities")
    best = written(rows_reaching(rows, find_thresholds(rows, k, by, key, probs_col), by, key, probs_col), "reaching")
    fall = F.when(F.isnan("prob"), F.lit(float("-inf"))).otherwise(-F.round("prob", 12))
    placed = with_index(best, [*by, "class_id", fall, key], out="_at")
    names = [*by, "class_id"]
    starts = placed.groupBy(*names).agg(F.min("_at").alias("_first"))                      # one row per class
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_first")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
    ranked = placed.join(F.broadcast(starts), same).select(
        *best.columns, (F.col("_at") - F.col("_first") + 1).cast("int").alias("rank"))
    return ranked.filter(F.col("rank") <= k)
