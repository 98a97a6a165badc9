"""Words of whole texts as byte ranges with 64-bit hashes, computed for a batch at once.

All separators are ASCII, so texts are cut as UTF-8 bytes. Bytes are looked at a block
at a time, so that one very long text needs no more working memory than many short ones;
what grows with a text is a few numbers per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shiftlab.llm.shingles import mix

#: Bytes whose words are cut and hashed in one step, and bytes of texts handled together.
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)


def byte_set(*parts: bytes | range) -> np.ndarray:
    """A table of 256 flags."""
    out = np.zeros(256, bool)
    for p in parts:
        out[list(p)] = True
    return out


#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = byte_set(b"\x20", range(0x09, 0x0E))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of several texts, in order: byte ranges, text number, number of the piece."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    piece: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _ODD, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _block_cuts(data: np.ndarray, sep: np.ndarray) -> list[int]:
    """Places near every ``BLOCK_BYTES`` where no word is cut."""
    cuts, at = [0], 0
    while at < len(data):
        at = min(at + BLOCK_BYTES, len(data))
        while at < len(data):
            hit = np.flatnonzero(sep[data[at:at + BLOCK_BYTES]])
            if len(hit):
                at += int(hit[0])
                break
            at = min(at + BLOCK_BYTES, len(data))
        cuts.append(at)
    return cuts


def cut_words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE,
              cut: np.ndarray | None = None) -> Words:
    """The maximal runs of bytes that are neither in ``white`` nor in ``cut``, in the texts
    ``data[offsets[i]:offsets[i + 1]]``. Bytes in ``cut`` and ends of texts also end a piece."""
    offsets = np.asarray(offsets, np.int64)
    sep = white if cut is None else white | cut
    bound = np.unique(offsets)
    parts, pieces_before = [], 0
    for a, b in zip(*(lambda c: (c[:-1], c[1:]))(_block_cuts(data, sep))):
        block = data[a:b]
        inside = ~sep[block]
        limits = bound[np.searchsorted(bound, a):np.searchsorted(bound, b)] - a
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        limits = limits[(limits > 0)]
        first[limits] = inside[limits]
        last[limits - 1] = inside[limits - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = e - s
        begin = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(begin, n)
        h = _BYTE_VALUES[block[inside]] * _powers(int(n.max()) if len(n) else 1)[k]
        h = mix(np.add.reduceat(h, begin) + n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)
        if cut is None:
            piece = np.zeros(len(s), np.int64)
        else:
            count = np.cumsum(cut[block])
            piece = count[s] + pieces_before
            pieces_before += int(count[-1]) if len(count) else 0
        parts.append((s + a, e + a, piece, h))
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    starts, ends, piece, h = (np.concatenate(x) for x in zip(*parts))
    doc = np.searchsorted(offsets, starts, "right") - 1
    # a text's end ends a piece as well
    step = np.ones(len(starts), bool)
    step[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    return Words(starts, ends, doc, np.cumsum(step) - 1, h)


def joined(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one blank after each, and the place of each word in that."""
    n = words.ends - words.starts
    place = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 0x20, np.uint8)
    for a in range(0, len(n), 1 << 18):
        w = slice(a, a + (1 << 18))
        k = np.arange(int(n[w].sum())) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
        out[np.repeat(place[w], n[w]) + k] = data[np.repeat(words.starts[w], n[w]) + k]
    return out, place


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts (null: empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    if raw is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(raw, np.uint8)[lo:hi], offsets - lo


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES, rows: int = 5000):
    """The batch in runs of rows with at most about ``size`` bytes in a column of texts."""
    n = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(n):
        k = max(1, int(np.searchsorted(np.cumsum(n[at:at + rows]), size, "right")))
        yield batch.slice(at, k)
        at += k
