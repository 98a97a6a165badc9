"""Word shingles and fast similarity sketches, one numpy pass per batch of texts.

Words are maximal runs of bytes other than space and ``\\t``-``\\r``, with A-Z lower-cased.
A text's shingles are its distinct runs of ``width`` consecutive words; a text with fewer
words has its whole word sequence as its one shingle; without words it has none. Shingles
are held as 64-bit hashes.

The sketch is that of Dahlgaard, Knudsen and Thorup ("Fast Similarity Sketching", 2017):
in round ``i`` every element is thrown into one of ``t`` bins with a fresh value, which is
kept if it is the bin's smallest; values of later rounds are larger. From round ``t`` on
all elements go to bin ``i - t``, so after at most ``2 t`` rounds every bin is filled. A
set stops at the first round after which all its bins are filled. Two sets agree in a bin
with the probability of their Jaccard similarity, with concentration like that of
independent samples.
"""

from __future__ import annotations

import hashlib

import numpy as np

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_EMPTY = _MASK
_VALUE_BITS = np.uint64(48)
#: Words kept by a task before its table of word hashes starts anew.
MAX_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised; wraps silently."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Table(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


_TABLE = _Table()


def forget_words() -> None:
    """Empty the table of word hashes, as a task does when it ends."""
    _TABLE.clear()


def shingle_sets(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and their numbers."""
    if len(_TABLE) > MAX_WORDS:
        _TABLE.clear()
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((_TABLE[w] for ws in words for w in ws), np.uint64, int(n.sum()))
    del words
    ends = np.cumsum(n)
    starts = ends - n
    k = np.where(n == 0, 0, np.maximum(n - width + 1, 1))        # shingles before removing repeats
    doc = np.repeat(np.arange(len(n)), k)
    first = np.repeat(starts - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    h = np.zeros(len(doc), np.uint64)
    last = ends[doc]
    for j in range(width):
        at = first + j
        inside = at < last
        h = np.where(inside, mix((h + np.uint64(0x9E3779B97F4A7C15 + j)) ^ flat[np.minimum(at, len(flat) - 1)])
                     if len(flat) else h, h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(n)).astype(np.int64)


def sketches(sets: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` 64-bit coordinates per set (round in the upper 16 bits). The rows
    of empty sets are all ones and mean nothing."""
    out = np.full((len(counts), t), _EMPTY, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    x = sets
    flat = out.reshape(-1)
    live = np.flatnonzero(counts)
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(x + np.uint64((0xD6E8FEB86659FD93 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (h & np.uint64((1 << 48) - 1)) | (np.uint64(i) << _VALUE_BITS)
        if i < t:
            place = ((h >> _VALUE_BITS) * np.uint64(t)) >> np.uint64(16)
        else:
            place = np.full(len(h), i - t, np.uint64)
        np.minimum.at(flat, doc * t + place.astype(np.int64), value)
        full = out[live].max(axis=1) != _EMPTY
        if full.any():
            done = np.zeros(len(counts), bool)
            done[live[full]] = True
            live = live[~full]
            keep = ~done[doc]
            x, doc = x[keep], doc[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per set and band; the band's number is part of the key."""
    s = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15),
                          (len(sketch), bands)).copy()
    for j in range(rows):
        key = mix(key ^ s[:, :, j]) + np.uint64(j + 1)
    return key.view(np.int64)
