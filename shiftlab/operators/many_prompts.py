"""T1 for many prompts in one pass over the items, with bounds that spare most products.

Each task takes its items in blocks sorted by falling norm and keeps every prompt's n best so
far. By Cauchy and Schwarz no product with an item exceeds the two norms' product, so a prompt
ends a block at the first item whose norm is too small for its n-th best. What is left is
multiplied over the first ``HEAD`` components only; the tails' norms bound the rest, and only
pairs that can still enter are finished. A first pass over a few items starts all tasks
with a threshold. The result is exact: bounds are compared with a margin above rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.operators.scoring import _to_matrix, _unit_rows, collect_class_matrix
from shiftlab.sources.tables import written

#: Items of a block, share of the components in the first product, items of the first pass.
BLOCK_ROWS, HEAD, FIRST_ITEMS = 4096, 0.25, 2000
_MARGIN = 1e-9


class _Best:
    """The n best (similarity, key) of every prompt so far."""

    def __init__(self, prompts: int, n: int, least: np.ndarray):
        self.n, self.least = n, least.copy()                      # what an item has to reach
        self.sims = [np.zeros(0)] * prompts
        self.keys: list = [None] * prompts

    def add(self, prompt: int, sims: np.ndarray, keys: np.ndarray) -> None:
        if self.keys[prompt] is not None:
            sims = np.concatenate([self.sims[prompt], sims])
            keys = np.concatenate([self.keys[prompt], keys])
        top = np.lexsort((keys, -sims))[:self.n]
        self.sims[prompt], self.keys[prompt] = sims[top], keys[top]
        if len(top) == self.n:
            self.least[prompt] = max(self.least[prompt], sims[top[-1]])


def _search(prompts: np.ndarray, n: int, scale: float, normalize: bool, least: np.ndarray):
    """(key, vector) -> (prompt, key, similarity) rows of the task's best, and a row with
    prompt -1 whose key counts (blocks, blocks ended early, pairs, pairs finished)."""
    dim = prompts.shape[1]
    head = max(1, int(dim * HEAD))
    norms, tails = np.linalg.norm(prompts, axis=1), np.linalg.norm(prompts[:, head:], axis=1)

    def run(batches):
        best, counts, kind = _Best(len(prompts), n, least), np.zeros(4, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            x_all, valid = _to_matrix(batch.column(1), dim)
            keys_all = batch.column(0).to_numpy(zero_copy_only=False)[valid]
            x_all = _unit_rows(x_all) if normalize else x_all
            fine = np.isfinite(x_all).all(axis=1)                 # a zero vector has no direction
            x_all, keys_all = x_all[fine], keys_all[fine]
            for at in range(0, len(x_all), BLOCK_ROWS):
                x, keys = x_all[at:at + BLOCK_ROWS], keys_all[at:at + BLOCK_ROWS]
                size = np.linalg.norm(x, axis=1)
                order = np.argsort(-size, kind="stable")
                x, keys, size = x[order], keys[order], size[order]
                margin = _MARGIN * (1 + size[0] * norms * abs(scale)) if len(size) else 0
                need = (best.least - margin) / abs(scale)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(norms > 0, need / norms, np.where(need <= 0, -np.inf, np.inf))
                ends = np.searchsorted(-size, -reach, "right")      # items whose norm suffices, per prompt
                counts += [len(prompts), int((ends < len(x)).sum()), len(prompts) * len(x), 0]
                rows = int(ends.max(initial=0))
                if not rows:
                    continue
                some = np.flatnonzero(ends)
                part = x[:rows, :head] @ prompts[some, :head].T
                rest = np.linalg.norm(x[:rows, head:], axis=1)[:, None] * tails[some][None, :]
                alive = (part + rest >= need[some][None, :]) & (np.arange(rows)[:, None] < ends[some][None, :])
                keep = np.flatnonzero(alive.any(axis=1))
                if not len(keep):
                    continue
                sims = x[keep] @ prompts[some].T * scale
                for j, p in enumerate(some.tolist()):
                    own = alive[keep, j]
                    counts[3] += int(own.sum())
                    if own.any():
                        best.add(p, sims[own, j], keys[keep[own]])
        if kind is None:
            return
        for p in range(len(prompts)):
            if best.keys[p] is not None and len(best.keys[p]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.keys[p]), p, np.int32)), pa.array(best.keys[p]).cast(kind),
                     pa.array(best.sims[p]), pa.nulls(len(best.keys[p]), pa.list_(pa.int64()))],
                    names=["prompt", "key", "sim", "counts"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.nulls(1, kind), pa.array([0.0]), pa.array([counts.tolist()], pa.list_(pa.int64()))],
            names=["prompt", "key", "sim", "counts"])
    return run


def top_n_many(items: DataFrame, prompts: DataFrame, n: int = 5, scale: float = 100.0, normalize: bool = True,
               key: str = "item_id", features: str = "features", id_col: str = "class_id",
               vec_col: str = "vec") -> tuple[DataFrame, DataFrame]:
    """The ``n`` items most similar to every prompt, and what the bounds spared.

    ``prompts`` holds dense ids and vectors (bounded like a class side). Returns
    ``(prompt_id, rank, <key>, similarity)``, per prompt as :func:`retrieval.top_n` gives it (ties
    to the smaller key, items without a direction left out), and one row ``(blocks, ended_early,
    pairs, finished)``: blocks times prompts, those ended before their last item, pairs of items
    and prompts, and pairs whose product was computed in full. With ``normalize=False`` the
    similarity is the inner product, where norms spare whole ends of blocks.
    """
    if scale <= 0 or n <= 0:
        raise ValueError("scale and n must be positive")
    q, _ = collect_class_matrix(prompts, id_col, vec_col)
    q = _unit_rows(q) if normalize else q
    rows = items.select(key, features)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"prompt int, key {kind}, sim double, counts array<bigint>"
    none = np.full(len(q), -np.inf)

    def best_of(found, k):
        w = Window.partitionBy("prompt").orderBy(F.desc("sim"), F.asc("key"))
        return (found.where("prompt >= 0").withColumn("rank", F.row_number().over(w).cast("int"))
                .where(F.col("rank") <= k))

    # a threshold to start with: the n-th best among a few items
    first = best_of(rows.limit(FIRST_ITEMS).mapInArrow(_search(q, n, scale, normalize, none), schema), n)
    least = none.copy()
    for r in first.where(F.col("rank") == n).select("prompt", "sim").collect():        # one row per prompt
        least[r["prompt"]] = r["sim"] - _MARGIN * max(1.0, abs(r["sim"]))
    found = written(rows.mapInArrow(_search(q, n, scale, normalize, least), schema), "many-prompts")
    hits = best_of(found, n).select(F.col("prompt").alias("prompt_id"), "rank", F.col("key").alias(key),
                                    F.col("sim").alias("similarity"))
    c = [F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)).cast("bigint") for i in range(4)]
    spared = found.where("prompt < 0").agg(c[0].alias("blocks"), c[1].alias("ended_early"), c[2].alias("pairs"),
                                           c[3].alias("finished"))
    return hits, spared
