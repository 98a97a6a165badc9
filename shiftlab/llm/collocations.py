"""Phrase collocations by Toivonen's sampling: exact counts of all frequent phrases.

1. Phrases that are frequent in a sample of the rows, at a lowered threshold, are proposed
   level by level (one more word each time).
2. One pass over all rows counts every proposed phrase and the *negative border*: phrases that
   are not proposed though the parts without their first and without their last word are
   (all single words belong to one of the two). Every frequent phrase that has not been
   counted then holds a border phrase that turned out frequent: a failure.
3. An expansion pass counts whatever holds a failure and has no infrequent part outside the
   failures' reach. By induction over the length that closes the set: no further phrase can
   be frequent. The same pass counts the frequent phrases of step 2 by their text.

So the sample decides how much is counted and nothing else. Steps 1 and 2 count 64-bit hashes:
each slice of texts gives its sorted keys with their numbers as compressed runs, dealt to
parts by the key's upper bits and merged there. Two phrases with one hash could only raise a
count, so no frequent phrase is lost, and step 3, which gives the result, goes by the text.
Whether a part is proposed or frequent is looked up in a bitmap of bounded size that may
also say yes wrongly, which again only counts more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm import byte_words
from shiftlab.llm.common import release_memory, saved, tidy
from shiftlab.llm.key_filter import KeyFilter, key_filter
from shiftlab.llm.shingles import mix

#: Bytes that end a piece, and bytes between words.
CUTS = byte_words.byte_set(b".,;:!?", range(0x0A, 0x0E))
BLANKS = byte_words.byte_set(b" \t")
#: Rows in the sample, and the lowered threshold there as a share of the expected count.
SAMPLE_SHARE, LOWERED = 0.25, 0.5
#: Bytes of texts counted together in a task, and bytes of texts per part of the merge.
SLICE_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: Parts of a language's ranking that are ordered apart before the first ones are merged.
RANK_PARTS = 64

_NEXT = np.uint64(0x9E3779B97F4A7C15)
_TAB = b"\t"                                             # between language and phrase: no word has it


class _Slice:
    """The words of a slice of texts and, level by level, the phrases that start at them."""

    def __init__(self, batch: pa.RecordBatch):
        coded = batch.column(0).cast(pa.binary()).dictionary_encode()
        self.names = coded.dictionary
        data, offsets = byte_words.text_bytes(batch.column(1))
        self.data = byte_words.lowered(data)
        self.words = byte_words.cut_words(self.data, offsets, BLANKS, CUTS)
        self.lang = coded.indices.to_numpy()[self.words.doc]
        own = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")
                        for x in self.names.to_pylist()], np.uint64)
        #: phrases of ``level`` words: their starts in the words, and by word their hash
        self.level, self.at = 1, np.arange(len(self.words))
        self.key = mix(self.words.hash ^ own[self.lang]) if len(self.words) else self.words.hash

    def longer(self, good: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """One word more: phrases within a piece whose two parts are ``good`` (by start), and
        one of them ``wanted``, if that is given."""
        k, w = self.level + 1, self.words
        at = self.at[:np.searchsorted(self.at, len(w) - k + 1)]
        keep = good[at] & good[at + 1] & (w.piece[at] == w.piece[at + k - 1])
        if wanted is not None:
            keep &= wanted[at] | wanted[at + 1]
        at = at[keep]
        key = np.zeros(len(w), np.uint64)
        key[at] = mix(self.key[at] * _NEXT + w.hash[at + k - 1])
        self.level, self.at, self.key = k, at, key

    def marks(self, found: KeyFilter) -> np.ndarray:
        """By start: whether ``found`` may hold the phrase of this level."""
        out = np.zeros(len(self.words), bool)
        out[self.at] = found.may_hold(self.key[self.at])
        return out


def _slices(batches) -> Iterator[_Slice]:
    for batch in batches:
        for b in byte_words.slices(batch, 1, SLICE_BYTES, rows=100_000):
            s = _Slice(b)
            if len(s.words):
                yield s
            release_memory()


def _part_bounds(key: np.ndarray, parts: int) -> list[int]:
    """Where the parts of the key space begin and end in sorted keys."""
    part = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()


def _count_keys(levels: range, known: KeyFilter | None, parts: int):
    """(lang, text) -> runs (part, block) of the sorted hashes and numbers of a slice's phrases
    of ``levels`` words; phrases of several words need parts that ``known`` may hold."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for s in _slices(batches):
            found = []
            while True:
                if s.level in levels:
                    found.append(s.key[s.at])
                if s.level + 1 >= levels.stop:
                    break
                s.longer(s.marks(known))
            key, n = np.unique(np.concatenate(found), return_counts=True)
            del found, s
            bounds = _part_bounds(key, parts)
            rows = [(p, pack(np.diff(key[a:z], prepend=np.uint64(0)).tobytes() + n[a:z].astype(np.uint32).tobytes()))
                    for p, a, z in zip(range(parts), bounds[:-1], bounds[1:]) if z > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.binary())], names=["part", "block"])
    return tidy(run)


def _merge(least: int):
    """The runs of a part -> keys that occur ``least`` times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        keys, numbers = [], []
        for b in batches:
            for block in b.column("block"):
                raw = unpack(block.as_py())
                k = len(raw) // 12
                keys.append(np.cumsum(np.frombuffer(raw, np.uint64, k), dtype=np.uint64))
                numbers.append(np.frombuffer(raw, np.uint32, k, 8 * k))
        key, n = np.concatenate(keys), np.concatenate(numbers)
        del keys, numbers
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        n = np.add.reduceat(n, first)
        often = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(key[first][often].view(np.int64))], names=["key"])
    return run


def _often(rows: DataFrame, least: int, levels: range, known: KeyFilter | None, parts: int) -> DataFrame:
    runs = rows.mapInArrow(_count_keys(levels, known, parts), "part int, block binary")
    return saved(runs.groupBy("part").applyInArrow(_merge(least), "key long"), "phrase-keys")


def _gather(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Byte ranges of ``text`` as an array of binaries."""
    n = hi - lo
    ends = np.cumsum(n)
    out = text[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _pack(phrases: pa.Array, n: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([phrases, n], names=["phrase", "n"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _count_phrases(longest: int, frequent: KeyFilter, failed: KeyFilter, parts: int):
    """(lang, text) -> blocks (part, block) of a slice's phrases, as language, tab, phrase, with
    their numbers: those that may be ``frequent`` and those that may hold a ``failed`` one, and
    as an empty phrase (in part 0) all words of a language."""
    def counts(s):
        text, place = byte_words.joined(s.data, s.words)
        place = np.append(place, len(text))
        total = np.bincount(s.lang, minlength=len(s.names)).astype(np.int64)
        yield 0, _pack(pc.binary_join_element_wise(s.names, pa.scalar(b"", pa.binary()), _TAB), pa.array(total))
        good = s.marks(frequent)                          # may be frequent, as far as is known
        reach = s.marks(failed)                           # holds a failure
        while True:
            at = s.at[good[s.at]]
            key, first, n = np.unique(s.key[at], return_index=True, return_counts=True)
            at, bounds = at[first], _part_bounds(key, parts)
            for p, a, z in zip(range(parts), bounds[:-1], bounds[1:]):
                if z > a:
                    phrase = _gather(text, place[at[a:z]], place[at[a:z] + s.level] - 1)
                    yield p, _pack(pc.binary_join_element_wise(s.names.take(pa.array(s.lang[at[a:z]])), phrase, _TAB),
                                   pa.array(n[a:z].astype(np.int64)))
            if s.level == longest:
                return
            s.longer(good)
            held = np.zeros(len(good), bool)
            held[s.at] = reach[s.at] | reach[s.at + 1]
            good, reach = s.marks(frequent) | held, s.marks(failed) | held

    def run(batches):
        for s in _slices(batches):
            for part, block in counts(s):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary())],
                                                 names=["part", "block"])
    return tidy(run)


def _sum_phrases(least: int):
    """The blocks of a part -> exact counts of its phrases, from ``least`` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(block.as_py()).read_all() for b in batches for block in b.column("block")]
        total = pa.concat_tables(tables).group_by("phrase").aggregate([("n", "sum")])
        keep = pc.or_(pc.greater_equal(total["n_sum"], least), pc.ends_with(total["phrase"], _TAB))
        total = total.filter(keep).select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])
        yield from total.combine_chunks().to_batches(max_chunksize=1 << 16)
    return run


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, lang_col: str = "lang",
                     text_col: str = "text", id_col: str = "doc_id", sample: float = SAMPLE_SHARE) -> DataFrame:
    """``lang``, ``words``, ``phrase`` (words joined by a blank), ``n``: every phrase of up to
    ``longest`` words with ``least`` occurrences or more in a language, counted exactly, and
    per language a row with ``words`` = 0 for the number of all its words.

    Texts are lower-cased in A-Z; phrases lie within pieces. Null languages are ``und``, null
    texts empty; an empty table gives no rows. Rows are sampled by a hash of id and text.
    """
    if least < 1 or longest < 1:
        raise ValueError("least and longest must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       text.cast("binary").alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 20)).alias("place"))
    some = saved(rows.where(F.col("place") < int(sample * (1 << 20))).drop("place"), "sample")
    rows = rows.drop("place")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, some_parts = (max(1, -(-int(x) // PART_BYTES)) for x in (size, size * sample))
    lowered = max(1, int(least * sample * LOWERED))
    proposed = _often(some, lowered, range(1, 2), None, some_parts)
    for k in range(2, longest + 1):
        proposed = proposed.unionByName(
            _often(some, lowered, range(k, k + 1), key_filter(proposed, proposed.count()), some_parts))

    often = _often(rows, least, range(1, longest + 1), key_filter(proposed, proposed.count()), parts)
    failed = often.join(proposed, "key", "left_anti")
    counted = rows.mapInArrow(_count_phrases(longest, key_filter(often, often.count()),
                                             key_filter(failed, failed.count()), parts), "part int, block binary")
    total = counted.groupBy("part").applyInArrow(_sum_phrases(least), "phrase binary, n long")
    both = F.col("both")
    words = F.substring_index(both, "\t", -1)              # a language may hold tabs, a phrase does not
    return total.select(F.col("phrase").cast("string").alias("both"), "n").select(
        F.left(both, F.length(both) - F.length(words) - 1).alias("lang"),
        F.when(words == "", 0).otherwise(F.size(F.split(words, " ", -1))).alias("words"),
        words.alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000,
                 inside: tuple[int, int] = (80, 100), lang_col: str = "lang", text_col: str = "text",
                 id_col: str = "doc_id", sample: float = SAMPLE_SHARE) -> DataFrame:
    """The ``top`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a`` (its
    count), ``l`` and ``r`` (counts of its two parts at the cut with the lowest score), ``n``
    (words of the language), ``score`` = floor(2000000 a / (l + r)).

    Candidates have 2 to ``longest`` words and ``least`` occurrences. One is left out if its
    words lie inside a longer candidate with at least ``inside`` of its occurrences. Ties: the
    shortest first part; then ranks by score and a descending, phrase ascending. Products are
    taken as decimals. A language without candidates has no rows, nor has an empty table;
    null texts are empty, null languages ``und``, repeated rows count each.
    """
    phrases = saved(frequent_phrases(docs, least, longest, lang_col, text_col, id_col, sample), "frequent")
    split = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice(split, a, n), " ")                      # noqa: E731
    candidates = phrases.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), part(1, F.col("cut")).alias("part")),
        F.struct(F.lit(False).alias("first"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("part"))))
        .alias("p")).select("lang", "phrase", "a", "cut", "p.*")
    known = phrases.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    scored = (parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut")
              .agg(F.max(F.when(F.col("first"), F.col("count"))).alias("l"),
                   F.max(F.when(~F.col("first"), F.col("count"))).alias("r")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")                                  # noqa: E731
    scored = scored.withColumn("l20", wide("l")).withColumn("r20", wide("r")).withColumn("a20", wide("a"))
    scored = scored.withColumn("score", F.expr("(a20 * 2000000BD) div (l20 + r20)").cast("long"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    # longest count of a longer candidate, for every phrase inside one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: part(i, m))))
    held = (candidates.where("words > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (scored.join(held, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() |
                   (wide("longer") * F.lit(inside[1]) < wide("a") * F.lit(inside[0]))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score",
                       F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    rows = rows.where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    n = phrases.where("words = 0").select("lang", "n")
    return (rows.where(F.col("rank") <= top).join(n, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
