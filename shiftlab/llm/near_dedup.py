"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

1. Every text's shingle set is sketched (``shingles.sketches``) once; equal sets are one
   class from then on, named by its smallest id.
2. The first ``bands * rows`` coordinates are cut into bands; classes that agree in a
   band share a bucket. At similarity 0.8 a pair misses all 32 bands of 4 with
   probability 5e-8.
3. Each class is compared with the smallest class of its buckets. Then, in buckets that
   still hold several components, classes of different components are compared: first
   each with its most similar one by sketch, then all that are left. A pair is passed
   over if its sketches agree in fewer than ``similarity - 0.1`` of 512 coordinates,
   5.6 standard deviations below the threshold. No pairs within a component are made,
   and a large bucket is compared in square tiles of ``TILE`` rows.
4. Every pair left is confirmed on the full sets (64-bit shingle hashes). Links make
   components by large-star and small-star steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm import shingles
from shiftlab.llm.common import components, flag_maybe_in, fresh, maybe_in, saved, tidy

BANDS, ROWS, COORDINATES = 32, 4, 512
SLACK = 0.1
TILE = 1024
#: Texts are handled in pieces of about so many bytes.
PIECE_BYTES = 1_500_000

_SKETCH = "id long, n long, set_key binary, bands array<long>, lanes binary"


def _pieces(batch):
    """(ids, texts) of a batch, about PIECE_BYTES bytes of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, side="right")))
        part = batch.slice(start, end - start)
        yield part.column(0).cast(pa.int64()), part.column(1).to_pylist()
        start = end


def _lanes(sketch: np.ndarray) -> np.ndarray:
    """Bytes of a sketch for estimates: 32 bits of the banded coordinates, 8 of the rest (equal
    coordinates stay equal; one of 256 others seems so, which only raises an estimate)."""
    banded = BANDS * ROWS
    a = np.ascontiguousarray((sketch[:, :banded] ^ (sketch[:, :banded] >> np.uint64(32))).astype(np.uint32))
    b = np.ascontiguousarray(sketch[:, banded:].astype(np.uint8))
    return np.concatenate([a.view(np.uint8), b.view(np.uint8)], axis=1)


def _sketch_batches(width: int):
    def run(batches):
        for batch in batches:
            for ids, texts in _pieces(batch):
                sets, n = shingles.shingle_sets(texts, width)
                s = shingles.sketches(sets, n, COORDINATES)
                bands = shingles.band_keys(s[:, :BANDS * ROWS], BANDS, ROWS)
                lanes = _lanes(s)
                ends = np.cumsum(n)
                raw = sets.astype("<u8").tobytes()
                keys = [hashlib.blake2b(raw[8 * (e - k):8 * e], digest_size=16).digest() if k else None
                        for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(n), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)),
                                             pa.array(bands.reshape(-1))),
                    pa.array([x.tobytes() for x in lanes], pa.binary())],
                    names=["id", "n", "set_key", "bands", "lanes"])
        shingles.forget_words()
    return tidy(run)


def _set_batches(width: int):
    def run(batches):
        for batch in batches:
            for ids, texts in _pieces(batch):
                sets, n = shingles.shingle_sets(texts, width)
                ends, raw = np.cumsum(n), sets.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([raw[8 * (e - k):8 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())],
                    names=["id", "members"])
        shingles.forget_words()
    return tidy(run)


def _verify(share: tuple[int, int]):
    """Keeps the pairs whose sets have ``of * intersection >= part * union``."""
    part, of = share

    def run(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_py(), "<u8"), np.frombuffer(b[i].as_py(), "<u8")
                if of * min(len(x), len(y)) < part * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = of * common >= part * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return tidy(run)


def _tile_pairs(share: tuple[int, int], best: bool):
    """Candidate pairs of the tiles of a sorted partition: rows of different components
    that meet here first and whose sketches agree enough; ``best``: of each row only the
    most similar."""
    least = share[0] / share[1] - SLACK
    banded = BANDS * ROWS

    def pairs(ids, comp, n, side, lanes, bucket, ti, tj):
        head = lanes[:, :4 * banded].copy().view(np.uint32)
        tail = lanes[:, 4 * banded:]
        left = np.flatnonzero(side == ti)
        right = np.flatnonzero(side == tj)
        for i in left:
            r = right[right > i] if ti == tj else right
            r = r[(comp[r] != comp[i]) & (share[1] * np.minimum(n[r], n[i]) >= share[0] * np.maximum(n[r], n[i]))]
            if not len(r):
                continue
            same = head[r] == head[i]
            score = same.sum(axis=1)
            ok = score >= banded * (least - 0.15)
            r, same, score = r[ok], same[ok], score[ok]
            if not len(r):
                continue
            first = same.reshape(len(r), BANDS, ROWS).all(axis=2).argmax(axis=1)
            if best:                                          # proposed by the banded coordinates alone; all come later
                ok = (first == bucket) & (score >= banded * least)
            else:
                score = score + (tail[r] == tail[i]).sum(axis=1)
                ok = (first == bucket) & (score >= COORDINATES * least)
            r, score = r[ok], score[ok]
            if len(r):
                yield (ids[i], ids[r[[score.argmax()]]] if best else ids[r])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            key = [rest.column(c).to_numpy() for c in ("bucket", "ti", "tj")]
            new = np.ones(rest.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield from made(rest.slice(0, starts[-1]), starts[:-1])
                rest = rest.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield from made(rest, np.zeros(1, np.int64))

    def made(t, starts):
        t = t.combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("band", "id", "comp", "n", "side", "ti", "tj")}
        size = 4 * banded + (0 if best else COORDINATES - banded)
        lanes = np.frombuffer(b"".join(t.column("lanes").to_pylist()), np.uint8).reshape(-1, size)
        out_a, out_b = [], []
        for s, e in zip(starts, [*starts[1:], t.num_rows]):
            w = slice(s, e)
            for a, b in pairs(cols["id"][w], cols["comp"][w], cols["n"][w], cols["side"][w], lanes[w],
                              cols["band"][s], cols["ti"][s], cols["tj"][s]):
                out_a.append(np.full(len(b), a))
                out_b.append(b)
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return tidy(run)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id
    reachable over links, itself included), ``kept`` (it is that id).

    Documents are linked when ``share[1] * |intersection| >= share[0] * |union|`` of their
    sets of ``width``-word shingles. A text that is null or has no words has no shingles
    and links with nothing. A row with a null id keeps its count, has a null component
    and is kept. Rows that repeat an id are one document. Ids are 64-bit integers.
    Further columns are ignored; an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    s = saved(text.mapInArrow(_sketch_batches(width), _SKETCH), "sketches")
    sets = s.where("n > 0 and id is not null")
    classes = sets.groupBy("set_key").agg(F.min("id").alias("rep"))
    members = saved(s.select("id", "n", "set_key").join(classes, "set_key", "left")
                    .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")),
                    "members")
    reps = members.where("n > 0 and id = rep").select("id").distinct()

    buckets = sets.select("id", "bands").join(reps, "id", "left_semi").select(
        "id", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other")).where("hub < other")
    buckets = saved(buckets.join(shared.select("bucket", "hub"), "bucket"), "buckets")
    wanted = buckets.select("id").distinct()
    wide = saved(maybe_in(text, F.col("id"), wanted).join(wanted, "id", "left_semi")
                 .mapInArrow(_set_batches(width), "id long, members binary"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x = (pairs.join(wide.select(F.col("id").alias("a"), F.col("members").alias("sa")), "a")
             .join(wide.select(F.col("id").alias("b"), F.col("members").alias("sb")), "b"))
        return saved(x.select("a", "b", "sa", "sb").mapInArrow(_verify(share), "a long, b long"), name)

    links = verified(buckets.where("hub < id").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")), "links")
    for best in (True, False):
        comps = saved(components(links), "components")
        of = (buckets.select("bucket", "band", "id").join(comps, "id", "left")
              .select("bucket", "band", "id", F.coalesce("component", "id").alias("comp")))
        mixed = (of.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                          F.count("*").alias("rows")).where("lo < hi")
                 .select("bucket", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles")))
        side = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        rows = of.join(mixed, "bucket")
        lanes = F.substring("lanes", 1, 4 * BANDS * ROWS) if best else F.col("lanes")
        lanes = maybe_in(sets.select("id", "n", lanes.alias("lanes")), F.col("id"), rows.select("id").distinct())
        rows = (rows.join(lanes.dropDuplicates(["id"]), "id")
                .withColumn("side", side)
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                .select("bucket", "band", F.least("side", "other").alias("ti"), F.greatest("side", "other").alias("tj"),
                        "id", "comp", "n", "side", "lanes"))
        rows = rows.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj", "id")
        pairs = rows.mapInArrow(_tile_pairs(share, best), "a long, b long").distinct()
        links = links.unionByName(verified(pairs, "links"))

    comps = components(links).select(F.col("id").alias("rep"), "component")
    return (members.join(comps, "rep", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "rep").alias("component_id"),
                    (F.col("id").isNull() | (F.col("id") == F.coalesce("component", "rep"))).alias("kept")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they
    are; rows without an id stay."""
    gone, flag = fresh(docs, "_gone", "_flag")
    ids = saved(near_duplicates(docs, id_col, text_col, width, share).where("not kept")
                .select(F.col("doc_id").alias(gone)).distinct(), "gone")
    flagged = flag_maybe_in(docs, F.col(id_col).cast("long"), ids, flag)       # the others pass without a shuffle
    left = flagged.where(flag).drop(flag).join(ids, F.col(id_col) == F.col(gone), "left_anti")
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(left)
