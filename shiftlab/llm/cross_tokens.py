"""Tokens of two tokenizers over the same bytes: where both end a token, and which ids overlap.

Both tokenizers here never merge across a blank: the byte-level pre-tokenizer puts a blank in
front of what follows it, and no piece of the other vocabulary has its blank mark inside. So a
text is cut at blanks into *chunks* (a blank and what follows), each different chunk of a slice
is encoded once, and both ends of a chunk are ends of groups. Texts with a blank next to other
white space, or at an end, are encoded in one piece.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np

from shiftlab.llm import byte_words

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of chunks that one call of a tokenizer gets.
CALL_BYTES = 1 << 14

_BLANK = byte_words.byte_set(b" ")


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 bytes
    are their own characters, the others follow from U+0100 on in ascending order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Spelling:
    """The bytes of every id of a vocabulary."""

    pool: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> "Spelling":
        n = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(n) - n, n)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.pool[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Pair:
    """The two tokenizers of a worker process."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = _byte_alphabet()
        words = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = Spelling.of([bytes(alphabet[c] for c in w) if all(c in alphabet for c in w)
                                    else w.encode() for w in words])
        self.b_bytes = Spelling.of([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of blank + text by A, and of text by B (which puts a blank before it)."""
        a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return ([np.array(x.ids, np.int64) for x in a],
                [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)])


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(byte_path: str, piece_path: str) -> Pair:
    key = byte_path, piece_path
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


@dataclass
class Alignment:
    """Tokens and links of a list of units (chunks or whole texts), one unit after the other.

    ``good`` tells whether a unit's token bytes are its own bytes by both tokenizers; the
    others have no tokens. Links are in byte order: ``a`` and ``b`` are the two ids.
    """

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    a: np.ndarray
    b: np.ndarray
    link_ends: np.ndarray                   # links up to and with each unit


def _same(spelling: Spelling, ids: np.ndarray, raw: np.ndarray) -> bool:
    return int(spelling.length[ids].sum()) == len(raw) and bool((spelling.bytes_of(ids) == raw).all())


def align(pair: Pair, units: list[bytes], alone: int = 0) -> Alignment:
    """Align the units. Those before ``alone`` may be encoded many in one call: they neither
    are empty nor begin or end with white space, nor have a blank next to other white space."""
    calls, at = [], 0
    while at < alone:
        size, stop = 0, at
        while stop < alone and (stop == at or size < CALL_BYTES):
            size += len(units[stop]) + 1
            stop += 1
        calls.append((at, stop))
        at = stop
    calls += [(i, i + 1) for i in range(max(alone, 0), len(units))]
    good = np.ones(len(units), bool)
    lengths = np.array([len(u) + 1 for u in units], np.int64)
    a_ids, b_ids = [], []
    for first in range(0, len(calls), 64):
        some = calls[first:first + 64]
        joined = [b" ".join(units[x:y]) for x, y in some]
        a, b = pair.encode([j.decode("utf-8", "replace") for j in joined])
        for (x, y), raw, i, j in zip(some, joined, a, b):
            whole = np.frombuffer(b" " + raw, np.uint8)
            if not (_same(pair.a_bytes, i, whole) and _same(pair.b_bytes, j, whole)):
                # at least one unit's bytes change: find out which
                i, j = [], []
                for u in range(x, y):
                    p, q = (z[0] for z in pair.encode([units[u].decode("utf-8", "replace")]))
                    own = np.frombuffer(b" " + units[u], np.uint8)
                    if _same(pair.a_bytes, p, own) and _same(pair.b_bytes, q, own):
                        i.append(p)
                        j.append(q)
                    else:
                        good[u] = False
                i = np.concatenate(i) if i else np.zeros(0, np.int64)
                j = np.concatenate(j) if j else np.zeros(0, np.int64)
            a_ids.append(i)
            b_ids.append(j)
    a_ids = np.concatenate(a_ids) if a_ids else np.zeros(0, np.int64)
    b_ids = np.concatenate(b_ids) if b_ids else np.zeros(0, np.int64)
    unit_ends = np.cumsum(np.where(good, lengths, 0))
    a_ends, b_ends = np.cumsum(pair.a_bytes.length[a_ids]), np.cumsum(pair.b_bytes.length[b_ids])
    # Between two neighbouring ends (of any of the two) lies exactly one overlap.
    ends = np.union1d(a_ends, b_ends)
    a_at, b_at = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    both = (a_ends[a_at] == ends) & (b_ends[b_at] == ends) if len(ends) else np.zeros(0, bool)
    group_a, group_b = a_at[both] + 1, b_at[both] + 1              # tokens up to and with each group
    sa, sb = a_ids.tolist(), b_ids.tolist()
    names, a0, b0 = [], 0, 0
    for a1, b1 in zip(group_a.tolist(), group_b.tolist()):
        if a1 - a0 == 1 and b1 - b0 == 1:
            names.append(f"{sa[a0]}|{sb[b0]}")
        else:
            names.append(",".join(map(str, sa[a0:a1])) + "|" + ",".join(map(str, sb[b0:b1])))
        a0, b0 = a1, b1
    n_a = np.diff(np.searchsorted(a_ends, unit_ends, "right"), prepend=0)
    n_b = np.diff(np.searchsorted(b_ends, unit_ends, "right"), prepend=0)
    group_ends = np.searchsorted(ends[both], unit_ends, "right")
    cut = [0, *group_ends.tolist()]
    return Alignment(good, n_a, n_b, np.diff(group_ends, prepend=0),
                     [";".join(names[x:y]) for x, y in zip(cut[:-1], cut[1:])],
                     a_ids[a_at], b_ids[b_at], np.searchsorted(ends, unit_ends, "right"))


#: A blank beside white space of any kind.
_WHITE = re.compile(r" \s|\s ")


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], int, np.ndarray, np.ndarray]:
    """Different units of some texts: their bytes, how many are chunks of cut texts (these
    come first), the units of all texts one after the other, and how many each text has."""
    raw = data.tobytes()
    texts = len(offsets) - 1
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    ascii_white = byte_words.byte_set(b" ", range(0x09, 0x0E), range(0x1C, 0x20))
    white, blank = ascii_white[data], data == 0x20
    odd = np.zeros(texts, bool)
    # blank beside ASCII white space, or at an end of the text
    beside = np.flatnonzero((blank[:-1] & white[1:]) | (white[:-1] & blank[1:]))
    odd[np.searchsorted(offsets, beside, "right") - 1] = True
    odd[full] |= white[lo[full]] | blank[hi[full] - 1]
    # other white space is not ASCII; texts with it (it begins with one of these bytes) are looked at
    if len(data):
        wide = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        for t in np.unique(np.searchsorted(offsets, wide, "right") - 1):
            text = raw[lo[t]:hi[t]].decode("utf-8", "replace")
            odd[t] |= bool(_WHITE.search(" " + text + " "))
    w = byte_words.cut_words(data, offsets, _BLANK)
    cut = ~odd[w.doc]
    key, first, unit = np.unique(w.hash[cut], return_index=True, return_inverse=True)
    s, e = w.starts[cut][first], w.ends[cut][first]
    units = [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
    alone = np.flatnonzero(odd & full)
    units += [raw[lo[t]:hi[t]] for t in alone]
    n = np.bincount(w.doc[cut], minlength=texts)
    n[alone] = 1
    place = np.concatenate([w.doc[cut], alone])
    order = np.argsort(place, kind="stable")
    return units, len(key), np.concatenate([unit, len(key) + np.arange(len(alone))])[order], n
