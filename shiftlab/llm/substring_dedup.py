"""Substring deduplication: runs of words that also start somewhere else are removed.

A *window* is ``length`` consecutive words of one text. The work is dealt by *anchors*: the
anchor of a window is the run of ``q`` words in it with the smallest hash, so equal windows
have equal anchors. Neighbouring windows share an anchor occurrence; the words under them
are its *context*, and every window lies in exactly one context.

1. One pass counts the anchors. A window whose anchor occurs once occurs once.
2. A second pass keeps the contexts of anchors that occur twice or more, equal ones of a
   task once with their number.
3. Contexts are dealt to reference shards by anchor. A suffix automaton of a shard's contexts
   counts every run of words in them; the contexts are streamed through it, and where the
   match reaches ``length`` words and its run occurs twice, the window is repeated. An
   automaton holds about ``SHARD_WORDS`` words and never leaves its task: automata of a
   whole corpus broadcast to all documents would be neither bounded nor less than quadratic.
4. An anchor with more than ``HOT`` different contexts (a frequent phrase) is not one shard:
   its contexts get longer anchors, up to the window itself, which has one context.
5. The marked windows go back to the texts; overlapping ones merge into maximal spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm import byte_words
from shiftlab.llm.common import flag_maybe_in, fresh, saved, tidy
from shiftlab.llm.key_filter import KeyFilter, key_filter
from shiftlab.llm.shingles import mix

LENGTH = 35
#: Words of an anchor, as shares of the window: first, then where an anchor is too frequent.
ANCHOR_SHARES = (0.3, 0.65, 1.0)
#: Different contexts of one anchor that go to one automaton; more take a longer anchor.
HOT = 2000
#: Words of contexts in one automaton (and the rest of its last anchor's contexts).
SHARD_WORDS = 100_000
#: Words of contexts in one partition, about.
PARTITION_WORDS = 2_000_000

_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


def anchor_words(length: int) -> list[int]:
    return sorted({max(1, round(length * s)) for s in ANCHOR_SHARES})


def anchored(hashes: np.ndarray, lengths: np.ndarray, length: int, q: int):
    """Anchor occurrences of word sequences laid end to end (``lengths`` words each).

    Returns the anchors' 64-bit keys, the first word of each context, and its number of
    windows (its words are ``length - 1`` more). Ties go to the leftmost smallest hash.
    """
    none = np.zeros(0, np.int64)
    w = length - q + 1                                           # anchors to choose from in a window
    ends = np.cumsum(lengths)
    windows = np.maximum(lengths - length + 1, 0)
    if not windows.sum():
        return none, none, none
    run = np.zeros(len(hashes) - q + 1, np.uint64)
    for j in range(q):
        run = run * _MULTIPLY + hashes[j:len(hashes) - q + 1 + j]
    run = mix(run)
    # Smallest of each window by the doubling of prefixes: place of the leftmost minimum.
    best, span = np.arange(len(run)), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(run[b] < run[a], b, a)
        span += step
    first = np.repeat(ends - lengths - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    doc = np.repeat(np.arange(len(lengths)), windows)
    place = best[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return run[place[at]].view(np.int64), first[at], np.diff(np.append(at, len(first)))


def _cut(column: pa.Array):
    """Words of the different texts of a column: their bytes joined by blanks, the place of
    each word, hashes, words per text."""
    data, offsets = byte_words.text_bytes(column)
    words = byte_words.cut_words(data, offsets)
    text, place = byte_words.joined(data, words)
    return text.tobytes(), place, words.hash, np.bincount(words.doc, minlength=len(column)).astype(np.int64)


def _count_keys(length: int, q: int):
    """Per slice of texts: each anchor key and whether it occurs once or more often."""
    def run(batches):
        for batch in batches:
            for b in byte_words.slices(batch, 0):
                _, _, hashes, n = _cut(b.column(0))
                key, times = np.unique(anchored(hashes, n, length, q)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.minimum(times, 2), pa.int64())],
                                                 names=["key", "n"])
    return tidy(run)


def _emit(length: int, q: int, repeated: KeyFilter | None = None):
    """Rows (owner, weight, text) -> a row per context whose anchor may be in ``repeated``.

    Of a slice's equal texts only one names its contexts; the words of a context and its
    number ``n`` (weights of all its places in the slice) come with its first place.
    """
    def run(batches):
        for batch in batches:
            for b in byte_words.slices(batch, 2):
                text, place, hashes, lengths = _cut(b.column(2))
                key, first, windows = anchored(hashes, lengths, length, q)
                if repeated is not None:
                    maybe = repeated.may_hold(key)
                    key, first, windows = key[maybe], first[maybe], windows[maybe]
                place = np.append(place, len(text))
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, first, "right")
                lo, hi = place[first], place[first + windows + (length - 1)] - 1
                weight, owners = b.column(1).to_pylist(), b.column(0).to_pylist()
                number: dict[tuple, int] = {}
                rows, said = [], set()
                for k, a, n, d, x, y in zip(key.tolist(), (first - (ends - lengths)[doc]).tolist(), windows.tolist(),
                                            doc.tolist(), lo.tolist(), hi.tolist()):
                    words = text[x:y]
                    c = hashlib.blake2b(words, digest_size=16).digest()
                    known = number.get((k, c))
                    number[k, c] = (known or 0) + weight[d]
                    if known is None or (owners[d], a) not in said:
                        said.add((owners[d], a))
                        rows.append((owners[d], a, k, c, n, known is None, words if known is None else None))
                cols = list(zip(*rows)) if rows else [()] * 7
                own, at, k, c, n, new, words = cols
                total = [number[z] if f else None for z, f in zip(zip(k, c), new)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array(at, pa.int32()), pa.array(k, pa.int64()),
                     pa.array(c, pa.binary()), pa.array(n, pa.int32()), pa.array(total, pa.int64()),
                     pa.array(words, pa.binary())],
                    names=["owner", "at", "key", "context", "windows", "n", "words"])
    return tidy(run)


_CONTEXT = "owner binary, at int, key long, context binary, windows int, n long, words binary"


def _judge(length: int):
    """Contexts in order of their anchors -> which of their windows (bits of ``mask``) occur
    twice or more, by an automaton per shard."""
    from shiftlab.llm.suffix_automaton import SuffixAutomaton

    def verdicts(shard):
        automaton, texts = SuffixAutomaton(), []
        for key, context, n, words in shard:
            texts.append(words.split(b" "))
            automaton.add(texts[-1], n)
        automaton.finish()
        keys, contexts, masks = [], [], []
        for (key, context, _, _), text in zip(shard, texts):
            mask, window = 0, 1 - length
            for found, times in automaton.matches(text, length):
                if found == length and times > 1:
                    mask |= 1 << window
                window += 1
            if mask:
                keys.append(key)
                contexts.append(context)
                masks.append(mask)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contexts, pa.binary()),
                                           pa.array(masks, pa.int64())], names=["key", "context", "mask"])

    def run(batches):
        shard, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_WORDS and row[0] != last:
                    yield verdicts(shard)
                    shard, size = [], 0
                last = row[0]
                shard.append(row)
                size += row[3].count(b" ") + 1
        if shard:
            yield verdicts(shard)
    return tidy(run)


def _repeated_windows(rows: DataFrame, length: int, level: int = 0) -> DataFrame:
    """``rows``: owner (binary), weight (long), text (binary). Returns (owner, at, mask):
    bit ``i`` of ``mask`` says that the window from word ``at + i`` of the owner's text
    occurs twice or more, where an owner's row counts as ``weight`` occurrences."""
    q = anchor_words(length)[level]
    rows = rows.select("owner", "weight", "text")
    if level == 0:
        # every row weighs one here: anchors are counted from the texts alone
        keys = rows.select("text").mapInArrow(_count_keys(length, q), "key long, n long")
        keys = saved(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "anchors")
        repeated = key_filter(keys, keys.count())
    else:
        repeated = None
    found = saved(rows.mapInArrow(_emit(length, q, repeated), _CONTEXT), "contexts")
    # A context's words may come from any of its rows: all are equal.
    contexts = found.where("n is not null").groupBy("key", "context").agg(
        F.sum("n").alias("n"), F.first("words").alias("words"),
        F.first("windows").alias("windows"))
    contexts = saved(contexts, "different-contexts")
    sizes = contexts.groupBy("key").agg(F.sum("n").alias("times"), F.count("*").alias("different"))
    sizes = sizes.where("times > 1")
    cold = F.lit(True) if q == length else F.col("different") <= HOT
    total = contexts.agg(F.sum(F.col("windows") + (length - 1)).alias("n")).first()["n"] or 0
    live = contexts.join(sizes, "key")
    parts = max(1, -(-int(total) // PARTITION_WORDS))
    shards = (live.where(cold).select("key", "context", "n", "words")
              .repartition(parts, "key").sortWithinPartitions("key", "context"))
    verdict = shards.mapInArrow(_judge(length), "key long, context binary, mask long")
    if q < length:
        hot = saved(live.where(~cold).select(F.col("context").alias("owner"), F.col("n").alias("weight"),
                                             F.col("words").alias("text"), "key"), "hot-contexts")
        if not hot.isEmpty():
            inner = _repeated_windows(hot, length, level + 1)
            inner = inner.groupBy("owner").agg(F.expr("bit_or(shiftleft(mask, at))").alias("mask"))
            verdict = verdict.unionByName(
                inner.join(hot.select("owner", "key"), "owner")
                .select("key", F.col("owner").alias("context"), "mask"))
    verdict = saved(verdict, "repeated")
    return found.join(verdict, ["key", "context"]).select("owner", "at", "mask")


def _cover(length: int):
    """(id, text, [(at, mask)]) -> the words kept, and the maximal spans removed."""
    def run(batches):
        for batch in batches:
            for b in byte_words.slices(batch, 1):
                data, offsets = byte_words.text_bytes(b.column(1))
                words = byte_words.cut_words(data, offsets)
                text, place = byte_words.joined(data, words)
                text, place = text.tobytes(), np.append(place, len(text))
                n = np.bincount(words.doc, minlength=b.num_rows)
                ends = np.cumsum(n)
                kept, removed, spans = [], [], []
                for lo, hi, marks in zip((ends - n).tolist(), ends.tolist(), b.column(2).to_pylist()):
                    starts = [m["at"] + i for m in marks or () for i in range(m["mask"].bit_length())
                              if m["mask"] >> i & 1]
                    own: list[list[int]] = []
                    for s in sorted(starts):
                        if own and s <= own[-1][1]:
                            own[-1][1] = s + length
                        else:
                            own.append([s, s + length])
                    out, at = [], 0
                    for s, e in own + [[hi - lo, hi - lo]]:
                        if s > at:
                            out.append(text[place[lo + at]:place[lo + s] - 1])
                        at = e
                    kept.append(b" ".join(out))
                    removed.append(sum(e - s for s, e in own))
                    spans.append([{"start": s, "stop": e} for s, e in own])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                     pa.array(kept, pa.binary())],
                    names=["id", "n_words", "n_removed", "spans", "kept"])
    return tidy(run)


def remove_repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                             text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: the id column, ``n_words``, ``n_removed``, ``spans`` (the
    maximal runs of removed words, ``[start, stop)``), ``kept_text`` (the others, joined by
    one blank).

    A word goes if it lies in a window of ``length`` words that also starts at any other
    place, in this or another row. So all of a text with an equal copy goes from both. Words
    are runs of bytes other than ASCII white space, unchanged. Null and empty texts have no
    words; texts of fewer than ``length`` words lose none. Ids are only passed through: they
    may be null or repeated. An empty table gives no rows; further columns are ignored.
    """
    if not 1 <= length <= 60:
        raise ValueError("length must be from 1 to 60 words")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = docs.select(owner.alias("owner"), F.lit(1).cast("long").alias("weight"),
                       text.cast("binary").alias("text"))
    marks = _repeated_windows(rows, length).groupBy("owner").agg(
        F.collect_set(F.struct("at", "mask")).alias("marks"))      # as many as the text has contexts
    marks = saved(marks, "marks")
    base = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), owner.alias("owner"))
    base = flag_maybe_in(base, F.col("owner"), marks.select("owner"), "marked")
    plain = base.where(~F.col("marked")).select("id", "text", F.lit(None).cast(marks.schema["marks"].dataType)
                                                .alias("marks"))
    marked = base.where("marked").join(marks, "owner", "left").select("id", "text", "marks")
    id_type = docs.schema[id_col].dataType.simpleString()
    out = plain.unionByName(marked).mapInArrow(
        _cover(length), f"id {id_type}, n_words long, n_removed long, "
                                 "spans array<struct<start:int,stop:int>>, kept binary")
    name, = fresh(docs.select(id_col), "kept_text")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans",
                      F.col("kept").cast("string").alias(name))
