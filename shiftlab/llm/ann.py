"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are put on a sphere (``x -> (x, sqrt(M^2 - |x|^2)) / M`` with the largest norm M; a
query becomes ``(q, 0) / |q|``), where the largest inner product is the smallest distance.
Each of ``TABLES`` tables hashes with ``FUNCTIONS`` Gaussian (2-stable) projections
``floor((a x + b) / w)``; cells beyond ``CELLS`` count as the outermost, so a table has at
most ``(2 CELLS + 1) ** FUNCTIONS`` buckets and its directory of counts is small.

A query visits the occupied buckets of a table in descending estimated probability of
success: a neighbour's projection is normal around ``r`` times the query's, with ``r`` the
mean cosine of true neighbours, so a bucket's probability is a product of normal
integrals. It stops when the visited buckets' probabilities sum to the table's share of
the total and hold ``LEAST_ROWS`` rows. ``r`` and the share are measured: a few sample queries are
searched by brute force over all rows, and the share is the least that finds
``RECALL`` of their neighbours. Candidates of all tables are merged and ranked by exact
inner products.

Buckets are dealt to shards of about ``SHARD_ROWS`` rows (a larger bucket to several) and
queries to blocks of ``BLOCK_QUERIES``; a task sees one shard and one block at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm.common import saved

TABLES, FUNCTIONS, CELLS = 2, 6, 2
#: Width of a cell in standard deviations of a projection.
WIDTH = 0.9
SAMPLE_QUERIES, RECALL = 100, 0.955
LEAST_ROWS = 400
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
SHARES = np.arange(1, 101) / 100


class Hashes:
    """The tables' projections and what was measured for them."""

    def __init__(self, dim: int, largest: float, seed: int):
        g = np.random.default_rng(seed)
        self.dim, self.largest = dim, largest
        self.a = g.normal(size=(TABLES, dim + 1, FUNCTIONS))
        self.b = g.uniform(size=(TABLES, FUNCTIONS))
        self.mean = np.zeros((TABLES, FUNCTIONS))
        self.w = np.ones((TABLES, FUNCTIONS))
        self.cosine, self.share = 0.5, 1.0

    def place(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The vectors on the unit sphere."""
        n = np.sqrt((x ** 2).sum(axis=1))
        if query:
            return np.column_stack([x / n[:, None], np.zeros(len(x))])
        rest = np.sqrt(np.maximum(self.largest ** 2 - n ** 2, 0))
        return np.column_stack([x, rest]) / self.largest

    def project(self, placed: np.ndarray, t: int) -> np.ndarray:
        return placed @ self.a[t]

    def buckets(self, placed: np.ndarray, t: int) -> np.ndarray:
        c = np.floor((self.project(placed, t) - self.mean[t]) / self.w[t] + self.b[t])
        c = np.clip(c, -CELLS, CELLS).astype(np.int64) + CELLS
        return c @ ((2 * CELLS + 1) ** np.arange(FUNCTIONS))

    def success(self, placed: np.ndarray, t: int, occupied: np.ndarray) -> np.ndarray:
        """Estimated probability that a neighbour of each query lies in each occupied bucket."""
        p = self.project(placed, t) * self.cosine
        s = math.sqrt(max(1 - self.cosine ** 2, 1e-4)) * self.w[t] / WIDTH
        edges = np.concatenate([[-np.inf], np.arange(-CELLS + 1, CELLS + 1), [np.inf]])
        out = np.ones((len(p), len(occupied)))
        for k in range(FUNCTIONS):
            at = (edges - self.b[t, k]) * self.w[t, k] + self.mean[t, k]
            z = (at[None, :] - (p[:, k] + (1 - self.cosine) * self.mean[t, k])[:, None]) / s[k]
            mass = np.diff(_normal(z), axis=1)
            out *= mass[:, occupied // (2 * CELLS + 1) ** k % (2 * CELLS + 1)]
        return out

    def visited(self, placed: np.ndarray, t: int, occupied: np.ndarray, counts: np.ndarray, share: float):
        """For each query the numbers of the buckets it visits, in their order."""
        for i in range(0, len(placed), 256):
            p = self.success(placed[i:i + 256], t, occupied)
            order = np.argsort(-p, axis=1, kind="stable")
            mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) / p.sum(axis=1, keepdims=True)
            rows = np.cumsum(counts[order], axis=1)
            enough = (mass >= share - 1e-12) & (rows >= LEAST_ROWS)
            n = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(occupied))
            for j in range(len(order)):
                yield order[j, :n[j]]


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = np.abs(np.clip(z, -40, 40))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(z >= 0, 1 - tail, tail)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


_FOUND = "query_id long, vec_id long, score double"


def _brute(queries: np.ndarray, own: np.ndarray, k: int):
    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x, ids = _matrix(f["v"]), f["vec_id"].to_numpy()
            s = queries @ x.T
            for i, q in enumerate(own):
                row = np.where(ids == q, -np.inf, s[i])
                best = _top(row, ids, k)
                best = best[np.isfinite(row[best])]
                yield pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": row[best]})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _directory(rows: DataFrame, h: Hashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Occupied buckets and their counts by table."""
    def run(frames):
        for f in frames:
            if len(f):
                p = h.place(_matrix(f["v"]))
                for t in range(TABLES):
                    b, n = np.unique(h.buckets(p, t), return_counts=True)
                    yield pd.DataFrame({"t": t, "bucket": b, "n": n})

    got = rows.select("v").mapInPandas(run, "t int, bucket long, n long").groupBy("t", "bucket").agg(
        F.sum("n").alias("n")).toPandas().sort_values(["t", "bucket"])      # at most TABLES * 5 ** 6 rows
    return [(got[got.t == t]["bucket"].to_numpy(), got[got.t == t]["n"].to_numpy()) for t in range(TABLES)]


def fit(rows: DataFrame, dim: int, queries: DataFrame, k: int, seed: int) -> tuple[Hashes, list]:
    """Projections, cell widths, neighbour cosine and share, and the directory."""
    largest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    h = Hashes(dim, math.sqrt(largest) * (1 + 1e-9), seed)
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(2000).select("v").toPandas()
    placed = h.place(_matrix(some["v"]))
    for t in range(TABLES):
        p = h.project(placed, t)
        h.mean[t], h.w[t] = p.mean(axis=0), np.maximum(p.std(axis=0), 1e-9) * WIDTH
    directory = _directory(rows, h)
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(SAMPLE_QUERIES).toPandas()
    q, own = _matrix(sample["v"]), sample["vec_id"].to_numpy()
    if not len(q):
        return h, directory
    true = _best(rows.mapInPandas(_brute(q, own, k), _FOUND), k).select("query_id", "vec_id")
    near = true.join(rows, "vec_id").select("query_id", "v").toPandas()      # at most SAMPLE_QUERIES * k rows
    if not len(near):
        return h, directory
    at = pd.Series(range(len(own)), index=own).groupby(level=0).first()
    who = at[near["query_id"]].to_numpy()
    pq, pn = h.place(q, query=True), h.place(_matrix(near["v"]))
    h.cosine = float(np.clip((pq[who] * pn).sum(axis=1).mean(), 0.05, 0.999))
    needed = []
    for t, (occupied, counts) in enumerate(directory):
        p = h.success(pq, t, occupied)
        order = np.argsort(-p, axis=1, kind="stable")
        mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) / p.sum(axis=1, keepdims=True)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(occupied))[None, :], axis=1)
        b = place[who, np.searchsorted(occupied, h.buckets(pn, t))]
        needed.append(np.where(b > 0, mass[who, b - 1], 0.0))                # found once the share exceeds this
    least = np.min(needed, axis=0)
    h.share = float(next((s for s in SHARES if (least < s).mean() >= RECALL), 1.0))
    return h, directory


def _deal(directory) -> pd.DataFrame:
    """First shard and number of shards of every bucket."""
    out, shard = [], 0
    for t, (occupied, counts) in enumerate(directory):
        size = 0
        for b, n in zip(occupied.tolist(), counts.tolist()):
            if size and size + n > SHARD_ROWS:
                shard, size = shard + 1, 0
            parts = -(-n // SHARD_ROWS)
            out.append((t, b, shard, parts))
            shard, size = (shard + parts, 0) if parts > 1 else (shard, size + n)
        shard += 1
    return pd.DataFrame(out, columns=["t", "bucket", "shard", "parts"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            seed: int = 11) -> DataFrame:
    """For every row whose id is divisible by ``every`` its ``k`` nearest of all other rows found:
    ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (inner product in double precision;
    ties to the smaller id).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows with a null id. Vectors of different lengths have no inner product: each length is
    searched apart. Components keep the column's own type. Repeated rows count once; of different vectors with one id the best counts. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = (F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
            & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector_col, lambda x: x != 0))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = saved(rows, "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():      # one row per length
        out = out.unionByName(_nearest(rows.where(F.size("v") == r["n"]), r["n"], k, every, seed))
    return out


def _nearest(rows: DataFrame, dim: int, k: int, every: int, seed: int) -> DataFrame:
    """:func:`nearest` among vectors of one length."""
    kind = rows.schema["v"].dataType.simpleString()
    queries = rows.where(F.col("vec_id") % every == 0)
    h, directory = fit(rows, dim, queries, k, seed)
    deal = _deal(directory)
    lookup = {t: (d["bucket"].to_numpy(), d["shard"].to_numpy(), d["parts"].to_numpy()) for t, d in deal.groupby("t")}
    blocks = -(-queries.count() // BLOCK_QUERIES) or 1

    def filed(frames):
        for f in frames:
            if not len(f):
                continue
            p, salt = h.place(_matrix(f["v"])), f["salt"].to_numpy()
            for t, (buckets, shards, parts) in lookup.items():
                b = h.buckets(p, t)
                at = np.searchsorted(buckets, b)
                yield pd.DataFrame({"shard": shards[at] + salt % parts[at], "bucket": b, "vec_id": f["vec_id"], "v": f["v"]})

    def asked(frames):
        for f in frames:
            if not len(f):
                continue
            placed = h.place(_matrix(f["v"]), query=True)
            for t, (buckets, shards, parts) in lookup.items():
                counts = directory[t][1]
                out = []
                for i, visit in enumerate(h.visited(placed, t, buckets, counts, h.share)):
                    s = shards[visit]
                    for one in np.unique(s):
                        mine = visit[s == one]
                        for part in range(int(parts[mine[0]])):
                            out.append((int(one) + part, f["vec_id"].iloc[i], f["v"].iloc[i], buckets[mine].astype(np.int32)))
                if out:
                    yield pd.DataFrame(out, columns=["shard", "vec_id", "v", "visit"])

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("bucket", kind="stable")
        x, ids, b = _matrix(left["v"]), left["vec_id"].to_numpy(), left["bucket"].to_numpy()
        out = []
        for q, v, visit in zip(right["vec_id"], right["v"], right["visit"]):
            a, z = np.searchsorted(b, visit, "left"), np.searchsorted(b, visit, "right")
            n = z - a
            pick = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pick = pick[ids[pick] != q]
            s = x[pick] @ np.asarray(v, np.float64)
            best = _top(s, ids[pick], k)
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[pick][best], "score": s[best]}))
        return pd.concat(out)

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    left = (rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)))
            .mapInPandas(filed, f"shard long, bucket long, vec_id long, v {kind}")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = queries.mapInPandas(asked, f"shard long, vec_id long, v {kind}, visit array<int>").select("*", block)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(compare, _FOUND)
    return _best(found, k)
