"""Token ids in binary files with Elias-Fano document boundaries.

A data set is a folder of segment files in ascending id order. A segment holds

====================  =======================================================
``SLTOKEF1``          8 bytes
``n, u, l, w, s, h``  six little-endian uint64: documents, ids, low bits per
                      boundary, bytes per id (2 or 4), select samples, bytes of ``high``
``valid``             ceil(n / 8) bytes, a bit per document: its id is not null
``doc_ids``           n int64
``low``               ceil(n l / 8) bytes: the low ``l`` bits of every boundary
``high``              h bytes: the boundaries' upper parts in unary
``samples``           s uint64: place in ``high`` of every 256th one
``ids``               u ids of ``w`` bytes each, one document after the other
====================  =======================================================

Boundary ``i`` is the place behind the last id of document ``i``. It takes ``2 + l`` bits
(``l`` is about log2 of the mean document length) and is read with one select: the
``i``-th one of ``high``, found from its sample, gives the upper part.

The folder lies under the shared checkpoint folder (or any path that ``pyarrow.fs`` can
open). Files are written under a name of the attempt's own and then renamed, so a
repeated task leaves the same files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm import byte_words
from shiftlab.llm.common import saved, tidy
from shiftlab.llm.token_ids import encoder, vocabulary_path
from shiftlab.session import scratch_path

MAGIC = b"SLTOKEF1"
SAMPLE = 256
#: Ids after which a segment is closed: bounds the memory of a writing or reading task.
SEGMENT_IDS = 8_000_000
#: Bytes of texts encoded together, a thousand texts at most.
SLICE_BYTES = 8 << 20
_HEAD = struct.Struct("<6Q")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of ``n`` numbers up to ``u`` in about ``n (2 + log2(u / n))`` bits."""

    def __init__(self, n: int, u: int, l: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.u, self.l = n, u, l
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = samples

    @classmethod
    def build(cls, values: np.ndarray, u: int) -> "EliasFano":
        n = len(values)
        l = max(0, (u // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1) if l else np.zeros((n, 0))
        low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        flags = np.zeros((u >> l) + n + 1, np.uint8)
        flags[ones] = 1
        return cls(n, u, l, low, np.packbits(flags, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.l):
            at = i * self.l + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """Number ``i`` of the sequence, from the nearest sample on."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        head = int(self.high[byte]) & ~((1 << (at & 7)) - 1) & 0xFF
        while left >= int(_ONES[head]):
            left -= int(_ONES[head])
            byte += 1
            head = int(self.high[byte])
        for _ in range(left):
            head &= head - 1
        place = 8 * byte + (head & -head).bit_length() - 1
        return ((place - i) << self.l) | int(self._low(np.array([i]))[0])

    def select_all(self) -> np.ndarray:
        """Every number, by one select over all ones."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        i = np.arange(self.n)
        return ((places - i) << self.l) | self._low(i)


def segment_bytes(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    u = len(ids)
    w = 2 if not u or int(ids.max()) < 1 << 16 else 4
    ef = EliasFano.build(ends, u)
    valid = np.packbits(np.array([d is not None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    return b"".join([MAGIC, _HEAD.pack(len(doc_ids), u, ef.l, w, len(ef.samples), len(ef.high)), valid,
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), ef.low.tobytes(),
                     ef.high.tobytes(), ef.samples.tobytes(), ids.astype(f"<u{w}").tobytes()])


class Segment:
    """A segment file's content: ``doc_ids``, ``ends`` (an :class:`EliasFano`), ``ids``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token segment")
        n, u, l, w, s, h = _HEAD.unpack_from(data, 8)
        at = 8 + _HEAD.size

        def take(k):
            nonlocal at
            at += k
            return data[at - k:at]

        valid = np.unpackbits(np.frombuffer(take((n + 7) // 8), np.uint8), bitorder="little")[:n]
        raw = np.frombuffer(take(8 * n), "<i8")
        self.doc_ids = [int(d) if v else None for d, v in zip(raw, valid)]
        low, high = take((n * l + 7) // 8), take(h)
        self.ends = EliasFano(n, u, l, low, high, np.frombuffer(take(8 * s), "<u8"))
        self.ids = np.frombuffer(take(u * w), f"<u{w}")

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i``, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]


def _open(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:")
                                  else "file://" + folder[5:])


def _write(folder: str, path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        docs, parts, lengths, size = [], [], [], 0

        def close():
            nonlocal docs, parts, lengths, size, number
            name = f"part-{part:06d}-{number:06d}.ids"
            data = segment_bytes(docs, np.cumsum(np.concatenate(lengths)), np.concatenate(parts))
            own = f"{root}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(data)
            system.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "file": [name],
                                              "n_docs": [len(docs)], "n_ids": [size]})
            docs, parts, lengths, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for b in byte_words.slices(batch, 1, size=SLICE_BYTES, rows=1000):
                ids, n = encoder(path).encode(b.column(1))
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(n + 1) - 1] = False
                out[keep] = ids
                docs += b.column(0).to_pylist()
                parts.append(out)
                lengths.append(n + 1)
                size += len(out)
                if size >= SEGMENT_IDS:
                    yield close()
        if docs:
            yield close()
        encoder(path).clear()
    return tidy(run)


def _read(folder: str):
    def run(batches):
        system, root = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{root}/{name}") as f:
                    s = Segment(f.read())
                ends = s.ends.select_all()
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(s.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                for at in range(0, len(crc), 10_000):
                    w = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids[w], pa.int64()), pa.array(base + starts[w]), pa.array(ends[w] - starts[w]),
                         pa.array(crc[w], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return tidy(run)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                      vocabulary: str | None = None, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text, append ``end_id`` to each and write the ids in ascending
    order of the id column (null ids first, equal ids by a hash of the text). Returns the folder and its
    manifest: a row per file with ``file``, ``n_docs``, ``n_ids`` and ``base``, the ids of
    all files before it.

    A null or empty text gives the end id alone. An empty table gives no files. Repeated
    rows are written each; further columns are ignored. The manifest has a row per
    ``SEGMENT_IDS`` ids and task, so the running sum over it stays small.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("salt"))
    order = [F.col("id").asc_nulls_first(), F.col("salt")]         # one id may hold many rows
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = saved(rows.mapInArrow(_write(folder, vocabulary or vocabulary_path(), end_id),
                                     "part long, number long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """A row per document from the files: ``doc_id``, ``start`` (ids of all documents before
    it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit integers)."""
    # as many tasks as files: the small manifest must not be merged into one task
    files = manifest.select("file", "base").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
