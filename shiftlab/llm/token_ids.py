"""Token ids of whole texts with a public tokenizer file, one encoding per distinct word.

The vocabulary used here (``word_bpe_49k.json``) drops white space, lower-cases and
splits every text into letter runs, single digits and symbol runs before its merges
apply. So a text cut at spaces gives the same ids word by word as in one piece, and
each distinct word is encoded by the tokenizers library only once per worker process.
Texts that hold ``<|`` (the start of a special token) are always encoded in one piece.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a task before its word table starts anew (about 100 MB).
MAX_WORDS = 400_000
VOCABULARY = "word_bpe_49k.json"

_SLICE = 1 << 18
_LETTERS = "A-Za-zÀ-ÖØ-Þß-öø-ÿ"
_SIMPLE = re.compile(rf"[{_LETTERS}]+")
_ENDED = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~]+)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts; keeps the ids of the words it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.most = MAX_WORDS
        self.clear()

    def clear(self):
        """Forget all words."""
        self.index: dict[str, int] = {"": 0}          # word -> row of the two tables below
        self.starts = np.zeros(1 << 16, np.int64)     # first id in the pool
        self.lengths = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.index), len(words)
        while n + k > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[n:n + k] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:n + k] = lengths
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + k)))

    def _ids(self, word: str) -> np.ndarray:
        i = self.index[word]
        return self.pool[self.starts[i]:self.starts[i] + self.lengths[i]]

    def _learn(self, words: list[str]) -> None:
        """Encode words that are new. Letter runs go to the tokenizer many at a time,
        split again by its own word numbers; a letter run with symbols after it is the
        ids of the run and those of the symbols; any other word is encoded alone."""
        runs, ended, other = set(), [], []
        for w in words:
            if _SIMPLE.fullmatch(w):
                runs.add(w)
            elif m := _ENDED.fullmatch(w):
                ended.append((w, m[1], m[2]))
                runs.add(m[1])
                if m[2] not in self.index:
                    other.append(m[2])
            else:
                other.append(w)
        runs = [w for w in runs if w not in self.index]
        for at in range(0, len(runs), 20_000):
            part = runs[at:at + 20_000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            self._put(part, np.array(e.ids, np.uint32),
                      np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        other = list(dict.fromkeys(w for w in other if w not in self.index))
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self._put(other, np.array([i for x in ids for i in x], np.uint32),
                      np.array([len(x) for x in ids], np.int64))
        if ended:
            ids = [np.concatenate([self._ids(a), self._ids(b)]) for _, a, b in ended]
            self._put([w for w, _, _ in ended], np.concatenate(ids),
                      np.array([len(x) for x in ids], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, one text after the other, and the number of each text
        (null text: none)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(special):
            mask = np.zeros(len(texts), bool)
            mask[special] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        else:
            plain = texts
        flat_text = pc.ascii_lower(pc.replace_substring(plain, "\n", " "))
        flat_text = pc.replace_substring_regex(flat_text, r"([a-z])([.,]) ", r"\1 \2 ")
        pieces = pc.split_pattern(flat_text, " ")
        coded = pc.list_flatten(pieces).dictionary_encode()
        words = []
        if len(coded.dictionary):
            one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            words = pc.binary_join(one, " ")[0].as_py().split(" ")
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        if len(words) and rows.min() < 0:
            new = [words[i] for i in np.flatnonzero(rows < 0)]
            if len(self.index) + len(new) > self.most:
                self.clear()
                new = words
            self._learn([w for w in new if w])
            rows = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        of_word = coded.indices.to_numpy(zero_copy_only=False)
        lengths, starts = self.lengths[rows], self.starts[rows]
        ends = np.concatenate([[0], np.cumsum(lengths[of_word])])
        ids = np.empty(ends[-1], np.uint32)
        for at in range(0, len(of_word), _SLICE):       # a slice at a time: the index arrays stay small
            w = of_word[at:at + _SLICE]
            n = lengths[w]
            lo, hi = ends[at], ends[at + len(w)]
            ids[lo:hi] = self.pool[np.repeat(starts[w] - (ends[at:at + len(w)] - lo), n) + np.arange(hi - lo)]
        counts = np.diff(ends[pieces.offsets.to_numpy(zero_copy_only=False)])
        if len(special):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in special:
                e = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False)
                parts[i] = np.array(e.ids, np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, words: int = MAX_WORDS) -> Encoder:
    """The encoder of this worker process for a vocabulary file, which keeps at most ``words``.
    A task clears its words when it ends: worker processes are used again, also by other
    stages."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = words
    return _ENCODERS[path]
