"""Cross-tokenizer alignment with corpus-wide pair counts by external spill counting.

1. A pass aligns all texts (:mod:`cross_tokens`). The texts of about ``RUN_BYTES`` form a
   *run*: a row per text, and its pair-document records (pair of ids, text, links) sorted by
   B id, A id and text. They are split by a radix of the B id into ``RADIX`` parts, and the
   heads (pair, links) and records of a part are kept as one zstd block each.
2. Heads are merged by a heap, ``FAN`` runs at a time, into sorted runs of sums, and these
   again until there is one per part. Their order is B id first, so a B id's pairs pass in
   a row and its highest count is known when it ends.
3. Counts go back the same way: a merged run gives each of the runs it came from the counts
   of their pairs, down to the first runs, whose records turn them into sums of texts.

What a task holds is bounded by ``FAN`` runs of one part, whatever the size of the corpus:
different pairs are bounded by the vocabularies, and no id is a group of its own.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm import byte_words
from shiftlab.llm.common import saved, tidy
from shiftlab.llm.cross_tokens import BYTE_VOCABULARY, PIECE_VOCABULARY, align, chunks, tokenizer_pair

#: Bytes of texts in a run, parts of a run by the B id, and runs that are merged at once.
RUN_BYTES, RADIX, FAN = 4 << 20, 16, 128

#: A pair is one number, its B id first.
_SIDE_BITS = 24


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _spill(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as one zstd block; the first one ascends and is kept as steps."""
    head = np.diff(columns[0], prepend=0) if len(columns[0]) else columns[0]
    return zstandard.ZstdCompressor(level=3).compress(
        b"".join(np.ascontiguousarray(c, "<i8").tobytes() for c in (head, *columns[1:])))


def _load(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "<i8")
    out = list(raw.reshape(columns, -1))
    out[0] = np.cumsum(out[0])
    return out


def _records(unit: np.ndarray, of_text: np.ndarray, alignment, texts: int):
    """Sorted pair-document records of the units of all texts: pairs, their links and numbers
    of records, and the text and links of every record."""
    links = np.diff(alignment.link_ends, prepend=0)
    first = alignment.link_ends - links
    pair_of_link = (alignment.b << _SIDE_BITS) | alignment.a
    pairs, local = np.unique(pair_of_link, return_inverse=True)
    # equal units of a text once, with their number
    key, times = np.unique(of_text * max(len(links), 1) + unit, return_counts=True)
    doc, u = np.divmod(key, max(len(links), 1))
    n = links[u]
    at = np.repeat(first[u] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    record = local[at] * texts + np.repeat(doc, n)
    weight = np.repeat(times, n)
    order = np.argsort(record, kind="stable")
    record, weight = record[order], weight[order]
    new = np.ones(len(record), bool)
    new[1:] = record[1:] != record[:-1]
    begin = np.flatnonzero(new)
    weight = np.add.reduceat(weight, begin) if len(begin) else weight
    pair, doc = np.divmod(record[begin], texts)
    n_records = np.bincount(pair, minlength=len(pairs))
    live = n_records > 0                                   # units may be of texts without tokens only
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, pair, weight)
    return pairs[live], total[live], n_records[live], doc, weight


def _runs(byte_path: str, piece_path: str):
    """(id, text) -> rows of texts (part -1) and blocks of records (parts of the radix)."""
    def run(batches):
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        tokenizers = tokenizer_pair(byte_path, piece_path)
        for batch in batches:
            for b in byte_words.slices(batch, 1, RUN_BYTES, rows=100_000):
                name, number = (task << 24) | number, number + 1
                data, offsets = byte_words.text_bytes(b.column(1))
                units, cut, unit, n = chunks(data, offsets)
                al = align(tokenizers, units, cut)
                texts = b.num_rows
                of_text = np.repeat(np.arange(texts), n)
                good = np.ones(texts, bool)
                good[of_text[~al.good[unit]]] = False
                links = np.diff(al.link_ends, prepend=0)
                keep = good[of_text]
                ends = np.cumsum(n)

                def total(of_unit):
                    before = np.concatenate([[0], np.cumsum(np.where(keep, of_unit[unit], 0))])
                    return pa.array((before[ends] - before[ends - n]).astype(np.int64))

                hashes, names = [], unit.tolist()
                for ok, lo, hi in zip((good & (n > 0)).tolist(), (ends - n).tolist(), ends.tolist()):
                    hashes.append(hashlib.sha256(";".join([al.groups[u] for u in names[lo:hi]]).encode()).hexdigest()
                                  if ok else "")
                none = pa.nulls(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(texts, name)), pa.array(np.full(texts, -1, np.int32)),
                     pa.array(np.arange(texts)), b.column(0), total(al.n_a), total(al.n_b), total(al.n_groups),
                     total(links), pa.array(hashes, pa.string()), none, none], names=_NAMES)
                pairs, sums, counts, doc, weight = _records(unit[keep], of_text[keep], al, texts)
                part = (pairs >> _SIDE_BITS) % RADIX
                of_record = np.repeat(part, counts)
                rows = []
                for p in np.unique(part).tolist():
                    here, there = part == p, of_record == p
                    rows.append((p, _spill(pairs[here], sums[here]),
                                 _pack(counts[here], doc[there], weight[there])))
                if rows:
                    k = len(rows)
                    zero = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, name)), pa.array([r[0] for r in rows], pa.int32()), zero,
                         pa.nulls(k, b.column(0).type), zero, zero, zero, zero, pa.nulls(k, pa.string()),
                         pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                        names=_NAMES)
    return tidy(run)


_NAMES = ["run", "part", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "heads", "records"]


def _pack(counts: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> bytes:
    """Records of a part as one zstd block: how many each pair has, their texts and links."""
    raw = b"".join(np.ascontiguousarray(c, "<i4").tobytes() for c in (counts, doc, weight))
    return (len(counts)).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:]), "<i4")
    k = (len(raw) - n) // 2
    return raw[:n], raw[n:n + k], raw[n + k:]


def _merge(table: pa.Table) -> pa.Table:
    """Sorted runs of (pair, links) of one part and group -> one sorted run of their sums,
    by a heap of the runs' heads."""
    runs = [_load(h, 2) for h in table["heads"].to_pylist()]
    pairs, sums = [], []
    last, total = -1, 0
    for pair, n in heapq.merge(*(zip(p.tolist(), s.tolist()) for p, s in runs)):
        if pair != last:
            if last >= 0:
                pairs.append(last)
                sums.append(total)
            last, total = pair, 0
        total += n
    if last >= 0:
        pairs.append(last)
        sums.append(total)
    return pa.table({"run": table["group"][:1].cast(pa.int64()), "part": table["part"][:1],
                     "heads": pa.array([_spill(np.array(pairs, np.int64), np.array(sums, np.int64))], pa.binary())})


def _maxima(table: pa.Table) -> pa.Table:
    """The last run of a part -> the count of every pair, and whether no pair of the same B id
    has more: the B ids' pairs lie in a row."""
    out = []
    for block in table["heads"].to_pylist():
        pairs, sums = _load(block, 2)
        side = pairs >> _SIDE_BITS
        first = np.flatnonzero(np.diff(side, prepend=-1))
        high = np.repeat(np.maximum.reduceat(sums, first), np.diff(np.append(first, len(side)))) if len(side) else sums
        out.append(_spill(pairs, sums, (sums == high).astype(np.int64)))
    return pa.table({"run": table["run"], "part": table["part"], "counts": pa.array(out, pa.binary())})


def _hand_down(children: pa.Table, parent: pa.Table) -> pa.Table:
    """The counts of a merged run for the pairs of each run it came from."""
    pairs, sums, best = _load(parent["counts"][0].as_py(), 3)
    out = []
    for block in children["heads"].to_pylist():
        own = _load(block, 2)[0]
        at = np.searchsorted(pairs, own)
        out.append(_spill(own, sums[at], best[at]))
    return pa.table({"run": children["run"], "part": children["part"], "counts": pa.array(out, pa.binary())})


def _contribute(records: pa.Table, counts: pa.Table) -> pa.Table:
    """All parts of a run: the sums of its texts."""
    known = dict(zip(counts["part"].to_pylist(), counts["counts"].to_pylist()))
    best_sum, count_sum = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part, block in zip(records["part"].to_pylist(), records["records"].to_pylist()):
        n, doc, weight = _unpack(block)
        _, sums, best = _load(known[part], 3)
        if len(doc) and int(doc.max()) >= len(best_sum):
            more = np.zeros(int(doc.max()) + 1 - len(best_sum), np.int64)
            best_sum, count_sum = np.concatenate([best_sum, more]), np.concatenate([count_sum, more])
        weight = weight.astype(np.int64)
        np.add.at(best_sum, doc, weight * np.repeat(best, n))
        np.add.at(count_sum, doc, weight * np.repeat(sums, n))
    at = np.flatnonzero(count_sum)
    run = pa.array(np.full(len(at), records["run"][0].as_py() if len(records) else 0))
    return pa.table({"run": run, "place": pa.array(at), "n_best": pa.array(best_sum[at]),
                     "count_sum": pa.array(count_sum[at])})


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """A row per row of ``docs``: the id column, ``n_a``, ``n_b`` (tokens), ``n_groups`` (places
    where both end a token), ``n_links`` (overlapping A-B pairs of tokens), ``n_best`` (links
    whose pair of ids has the highest count of its B id in the corpus, ties included),
    ``count_sum`` (of the counts of all its links' pairs), ``groups_sha256``.

    Null and empty texts, and texts whose tokens do not spell blank + text by both tokenizers
    (as with U+2581 in them), have no tokens: zeros and an empty string. Ids are only passed
    through and may be null or repeated; repeated rows count each. An empty table gives no
    rows; further columns are ignored. A very long text is a run of its own.
    """
    byte_path = byte_vocabulary or vocabulary_path(BYTE_VOCABULARY)
    piece_path = piece_vocabulary or vocabulary_path(PIECE_VOCABULARY)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = saved(rows.mapInArrow(
        _runs(byte_path, piece_path),
        f"run long, part int, place long, id {id_type}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, heads binary, records binary"), "token-runs")
    blocks = runs.where("part >= 0")
    n = blocks.select("run").distinct().count()
    levels, heads = [], blocks.select("run", "part", "heads")
    while n > 1:
        n = -(-n // FAN)
        grouped = heads.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n)))
        levels.append(grouped)
        heads = saved(grouped.groupBy("part", "group").applyInArrow(
            _merge, "run long, part int, heads binary"), "merged-runs")
    counts = heads.groupBy("part").applyInArrow(_maxima, "run long, part int, counts binary")
    for grouped in reversed(levels):
        counts = saved(counts, "pair-counts").withColumnRenamed("run", "group")
        counts = grouped.groupBy("part", "group").cogroup(counts.groupBy("part", "group")).applyInArrow(
            _hand_down, "run long, part int, counts binary")
    sums = (blocks.select("run", "part", "records").groupBy("run").cogroup(counts.groupBy("run"))
            .applyInArrow(_contribute, "run long, place long, n_best long, count_sum long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)             # noqa: E731
    return (runs.where("part < 0").drop("heads", "records", "part").join(sums, ["run", "place"], "left")
            .select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"),
                    zero("count_sum"), "groups_sha256"))
