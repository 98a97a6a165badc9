"""Best-fit packing of documents into fixed-length sequences by bin completion.

Only lengths matter to the packing, and there are at most ``capacity`` of them, so the
plan is made on the histogram of piece lengths, which does not grow with the corpus:

* Take the largest length left. Enumerate its undominated completions by branch and
  bound: fill the rest of the sequence from larger to smaller lengths; the best-fit
  filling is the first incumbent, a branch ends when even a full rest cannot beat the
  incumbent's waste, and a filling that leaves room for another piece is dominated.
* Use the best completion as often as the counts allow. So every step uses up a length
  and the plan has at most a few thousand patterns.
* The plan of first descents alone (best fit, largest first) is the incumbent; while it
  exceeds the lower bound ``ceil(ids / capacity)`` sequences, the search runs with growing
  node budgets, and the best plan is kept.

The pieces then find their places by joins: piece number ``r`` among those of its length
belongs to the pattern whose range of numbers holds ``r``. A length with many pieces is
numbered in salted parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm import byte_words
from shiftlab.llm.common import saved, tidy
from shiftlab.llm.token_ids import MAX_WORDS, encoder, vocabulary_path

#: Nodes the search may visit for one completion; each is used while the best plan is not
#: proven optimal.
NODES = (2_000, 40_000)
#: Pieces numbered by one window.
PART_ROWS = 500_000
#: Bytes of texts encoded together, a thousand texts at most.
SLICE_BYTES = 8 << 20


def best_completion(room: int, lengths: list[int], counts: np.ndarray, nodes: int) -> list[int]:
    """Numbers (into the descending ``lengths``) of the pieces that fill ``room`` with the
    least waste found: depth-first branch and bound within ``nodes`` visited nodes (0: the
    first descent alone).

    The first descent is the best-fit filling. A branch ends when all pieces that are left
    for it together cannot beat the incumbent's waste; fillings with room for another
    piece are always extended, so only undominated ones are leaves.
    """
    keys = [-x for x in lengths]
    mass = np.concatenate([np.cumsum((np.array(lengths) * counts)[::-1])[::-1], [0]])
    chosen: list[int] = []
    used: dict[int, int] = {}
    best, waste, rest, i = [], room, room, 0
    left = nodes
    while waste and (left > 0 or not nodes):
        i = max(i, bisect_left(keys, -rest))
        while i < len(lengths) and used.get(i, 0) >= counts[i]:
            i += 1
        if i < len(lengths) and rest - mass[i] < waste:
            left -= 1
            chosen.append(i)
            used[i] = used.get(i, 0) + 1
            rest -= lengths[i]
            if rest < waste:
                best, waste = chosen[:], rest
            continue
        if not chosen or not nodes:
            break
        i = chosen.pop()
        used[i] -= 1
        rest += lengths[i]
        i += 1
    return best


def plan(histogram: dict[int, int], capacity: int, nodes: tuple[int, ...] = NODES) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence) with how many sequences use them."""
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    found: list[tuple[list[int], int]] | None = None
    for budget in (0, *nodes):
        lengths = sorted((k for k, n in histogram.items() if n > 0), reverse=True)
        counts = np.array([histogram[x] for x in lengths], np.int64)
        patterns = []
        while lengths:
            counts[0] -= 1
            pattern = [0, *best_completion(capacity - lengths[0], lengths, counts, budget)]
            counts[0] += 1
            need = Counter(pattern)
            times = min(int(counts[i]) // k for i, k in need.items())
            patterns.append(([lengths[i] for i in pattern], times))
            for i, k in need.items():
                counts[i] -= k * times
            left = np.flatnonzero(counts)
            lengths, counts = [lengths[i] for i in left], counts[left]
        if found is None or sum(t for _, t in patterns) < sum(t for _, t in found):
            found = patterns
        if sum(t for _, t in found) <= least:
            break
    return found


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool, slice_bytes: int = SLICE_BYTES,
            words: int = MAX_WORDS):
    def run(batches):
        for batch in batches:
            for b in byte_words.slices(batch, 1, size=slice_bytes, rows=1000):
                ids, n = encoder(path, words).encode(b.column(1))
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                ends = np.cumsum(n + 1)
                keep[ends - 1] = False
                out[keep] = ids
                raw = memoryview(out.astype("<u4").tobytes())
                docs = b.column(0).to_pylist()
                rows = []
                for d, s, e in zip(docs, (ends - n - 1).tolist(), ends.tolist()):
                    h = zlib.crc32(raw[4 * s:4 * e])
                    for k, a in enumerate(range(s, e, capacity)):
                        z = min(a + capacity, e)
                        rows.append((d, h, k, a - s, z - a, zlib.crc32(raw[4 * a:4 * z]),
                                     bytes(raw[4 * a:4 * z]) if keep_ids else None))
                names = ["doc_id", "text_crc", "piece", "start", "length", "ids_crc32", "ids"]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        encoder(path).clear()
    return tidy(run)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
                   end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False,
                   slice_bytes: int = SLICE_BYTES, words: int = MAX_WORDS) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` (and ``ids``, little-endian 32-bit, if ``with_ids``).

    A document is its whole text's ids and the end id (a null or empty text the end id
    alone); only one longer than ``capacity`` is cut. Pieces are packed whole; a
    sequence's pieces lie without gaps from 0. Ties are broken by document, piece and
    content; rows equal in all of these (repeated rows) take their places in any order. Null ids
    are ids like any other. An empty table gives no rows; further columns are ignored.
    ``slice_bytes`` and ``words`` bound what a task holds: bytes of texts encoded together and
    words whose ids are kept. They change no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = saved(rows.mapInArrow(
        _pieces(vocabulary or vocabulary_path(), end_id, capacity, with_ids, slice_bytes, words),
        "doc_id long, text_crc long, piece int, start long, length long, ids_crc32 long, ids binary"), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}

    # Which numbers among the pieces of a length a pattern takes, from which place on.
    taken = dict.fromkeys(histogram, 0)
    ranges, first_sequence = [], 0
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            k = pattern.count(x)
            ranges.append((x, taken[x], taken[x] + k * times, k, first_sequence, offset))
            taken[x] += k * times
            offset += k * x
        first_sequence += times
    places = spark.createDataFrame(
        ranges, "length long, lo long, hi long, each long, first_sequence long, first_offset long")

    parts = spark.createDataFrame([(x, -(-n // PART_ROWS)) for x, n in histogram.items()], "length long, parts long")
    order = ["doc_id", "piece", "text_crc", "ids_crc32"]
    salted = (pieces.drop("ids").join(F.broadcast(parts), "length")       # a row per distinct length
              .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "text_crc"), F.col("parts"))))
    sizes = salted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    numbered = (salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1)
                .join(sizes, ["length", "part"]).withColumn("n", F.col("n") + F.col("skip")))
    # The ranges of a length are looked up by interval; the plan is bounded by the histogram.
    steps = places.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("lo", "hi", "each", "first_sequence", "first_offset"))).alias("ranges"))
    hit = F.element_at(F.filter("ranges", lambda r: (r["lo"] <= F.col("n")) & (F.col("n") < r["hi"])), 1)
    out = numbered.join(F.broadcast(steps), "length").withColumn("r", hit)
    k = F.col("n") - F.col("r.lo")
    out = out.select("doc_id", "piece", "start", "length", "ids_crc32", "text_crc",
                     (F.col("r.first_sequence") + F.floor(k / F.col("r.each"))).cast("long").alias("sequence_id"),
                     (F.col("r.first_offset") + F.pmod(k, F.col("r.each")) * F.col("length")).cast("long")
                     .alias("offset"))
    if with_ids:
        ids = pieces.select("doc_id", "piece", "text_crc", "ids").dropDuplicates(["doc_id", "piece", "text_crc"])
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("doc_id", "piece", "text_crc")]
        out = out.alias("o").join(ids.alias("i"), same[0] & same[1] & same[2]).select("o.*", "i.ids")
    return out.drop("text_crc")
