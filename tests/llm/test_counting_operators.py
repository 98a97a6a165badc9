"""Cross-tokenizer alignment, substring deduplication and collocations against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shiftlab.llm import byte_words, collocations, cross_alignment, cross_tokens, substring_dedup
from shiftlab.llm.key_filter import key_filter
from shiftlab.llm.suffix_automaton import SuffixAutomaton

CLASH = ", key long, owner string, n long, run long, part int, place long, words string, id long, mask long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_clashes(df):
    names = [x.split()[0] for x in CLASH[2:].split(", ")]
    return df.select("*", *[F.lit(None).cast(x.split()[1]).alias(n) for n, x in zip(names, CLASH[2:].split(", "))])


# Words of a batch

@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab. é,\n\t\x0b\x1c x", max_size=40)), max_size=6),
       st.sampled_from([3, 11, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_words_and_pieces(texts, block):
    before, byte_words.BLOCK_BYTES = byte_words.BLOCK_BYTES, block
    try:
        data, offsets = byte_words.text_bytes(pa.array(texts, pa.string()))
        w = byte_words.cut_words(data, offsets)
        got = [(int(d), bytes(data[s:e])) for d, s, e in zip(w.doc, w.starts, w.ends)]
        assert got == [(i, x) for i, t in enumerate(texts)
                       for x in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
        text, _ = byte_words.joined(data, w)
        assert bytes(text) == b"".join(x + b" " for _, x in got)
        assert len({x for _, x in got}) == len(set(w.hash.tolist()))
        w = byte_words.cut_words(data, offsets, collocations.BLANKS, collocations.CUTS)
        pieces = collections.defaultdict(list)
        for p, s, e in zip(w.piece.tolist(), w.starts, w.ends):
            pieces[p].append(bytes(data[s:e]))
        want = [re.findall(rb"[^\x20\x09]+", p) for t in texts
                for p in re.split(rb"[.,;:!?\x0a-\x0d]", (t or "").encode())]
        assert list(pieces.values()) == [p for p in want if p]
    finally:
        byte_words.BLOCK_BYTES = before


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 100, 3, 3, 3)])], names=["t"])
    got = [b.column(0).to_pylist() for b in byte_words.slices(batch, 0, size=10, rows=2)]
    assert sum(got, []) == batch.column(0).to_pylist() and all(len(g) <= 2 for g in got)


def test_key_filter_has_all_members(spark):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 5000)
    f = key_filter(spark.createDataFrame([(int(k),) for k in keys[:2500]], "k long"), 2500)
    assert f.may_hold(keys[:2500]).all() and f.may_hold(keys[2500:]).mean() < 0.1


# Substring deduplication

@given(st.lists(st.tuples(st.text(alphabet="abc", max_size=12), st.integers(1, 3)), max_size=6),
       st.text(alphabet="abcd", max_size=15), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_automaton_counts_and_matches(added, text, longest):
    a = SuffixAutomaton()
    for s, n in added:
        a.add(s, n)
    a.finish()

    def times(run):
        return sum(n * sum(s.startswith(run, i) for i in range(len(s) - len(run) + 1)) for s, n in added)

    for end, (n, count) in enumerate(a.matches(text, longest), 1):
        fits = [k for k in range(1, min(end, longest) + 1) if times(text[end - k:end])]
        assert n == max(fits, default=0)
        assert count == (times(text[end - n:end]) if n else 0)


def repeats(data, length):
    words = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in data]
    seen = collections.Counter(tuple(w[k:k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                gone[k:k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def passages(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(6)] + ["é", "a\tb"]
    data = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        if data and r.random() < 0.3:
            other = r.choice(data)[1] or ""
            text += "\n" + other[r.randint(0, len(other) // 2):]
        data.append((r.choice([i, i, None, 5]), text if r.random() < 0.9 else None))
    return data + data[:1]


@pytest.mark.parametrize("hot, shard, length", [(2000, 100_000, 8), (2, 50, 8), (1, 10, 5), (3, 100, 3), (1, 10, 1)])
def test_repeated_passages(spark, monkeypatch, hot, shard, length):
    """Also with anchors too frequent for one automaton, and many small automata."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    data = passages(length)
    df = with_clashes(spark.createDataFrame(data, "doc_id long, text string"))
    got = substring_dedup.remove_repeated_passages(df, length)
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept_text")) == repeats(data, length)
    for r in got.collect():                                # maximal, ascending, as many words as removed
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeated_passages_on_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = substring_dedup.remove_repeated_passages(df).select("doc_id", "n_words", "n_removed", "kept_text")
    assert rows(got) == repeats([tuple(r) for r in df.select("doc_id", "text").collect()], 35)


def test_repeated_passages_edge_cases(spark):
    schema = "doc_id long, text string"
    assert substring_dedup.remove_repeated_passages(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"x{i % 9973}" for i in range(200_000))      # repeats itself after 9,973 words
    one = "y" * 3_000_000
    data = [(1, long), (2, one), (3, ""), (None, None), (4, one + " " + " ".join(f"z{i}" for i in range(40)))]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(data, schema))
    assert rows(got.select("doc_id", "n_words", "n_removed")) == rows(spark.createDataFrame(
        [(1, 200_000, 200_000), (2, 1, 0), (3, 0, 0), (None, 0, 0), (4, 41, 0)], "a long, b long, c long"))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated_passages(spark.createDataFrame(data, schema), length=0)


def test_minimal_anchor_is_shared_by_equal_windows():
    r = np.random.default_rng(0)
    words = r.integers(0, 4, 400).astype(np.uint64)
    key, first, windows = substring_dedup.anchored(words, np.array([0, 150, 3, 247]), 12, 4)
    assert windows.sum() == (150 - 11) + (247 - 11)
    of = {}
    for k, f, n in zip(key.tolist(), first.tolist(), windows.tolist()):
        for w in range(f, f + n):
            assert of.setdefault(words[w:w + 12].tobytes(), k) == k


# Collocations

def phrases(data, least, top):
    lower = {i: i + 32 for i in range(65, 91)}
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang in n:
        c = {p: a for p, a in f[lang].items() if a >= least and len(p) > 1}
        gone = {p[i:i + m] for p, b in c.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if 100 * b >= 80 * c[p[i:i + m]]}
        ranked = []
        for p, a in c.items():
            if p not in gone:
                s, _, left, right = min((2_000_000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k,
                                         f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), left, right))
        for j, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, j, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, least, top, sample", [(0, 3, 2000, 0.25), (1, 8, 7, 0.02), (2, 3, 50, 0.9), (3, 5, 2000, 0.0)])
def test_collocations(spark, monkeypatch, seed, least, top, sample):
    """Small and empty samples only need more passes."""
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Ab", "aB", "x'y"]
    data = [(r.choice([None, i]), r.choice([None, "en", "und", ""]), None if r.random() < 0.1 else "".join(
        r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(r.randint(0, 60))))
        for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, lang string, text string").select(
        "*", F.lit(1).alias("phrase"), F.lit(2).alias("n"), F.lit(3).alias("words"), F.lit(4).alias("rank"))
    got = collocations.collocations(df, least=least, top=top, sample=sample)
    assert rows(got) == phrases(data, least, top)


def test_border_failures_are_followed(spark):
    """Phrases that no sampled row holds are found, through their words."""
    df = spark.createDataFrame([(i, "en", "a b c d e") for i in range(5)], "doc_id long, lang string, text string")
    got = rows(collocations.frequent_phrases(df, least=5, sample=0.0))
    assert len(got) == 5 + 4 + 3 + 2 + 1 and all(r[3] == (25 if r[1] == 0 else 5) for r in got)


def test_collocations_edge_cases(spark):
    schema = "doc_id long, lang string, text string"
    assert collocations.collocations(spark.createDataFrame([], schema)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None, None), (1, "en", "")], schema)).collect() == []
    data = [(1, "en", "one two " * 300_000)]
    assert rows(collocations.collocations(spark.createDataFrame(data, schema))) == phrases(data, 30, 2000)


# Cross-tokenizer alignment

def aligned(data):
    pair = cross_tokens.tokenizer_pair(*map(cross_alignment.vocabulary_path, (
        cross_tokens.BYTE_VOCABULARY, cross_tokens.PIECE_VOCABULARY)))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable}
    alphabet |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}

    def cuts(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    count, docs = collections.Counter(), []
    for i, text in data:
        docs.append((i, None))
        if not text:
            continue
        a = pair.a.encode(" " + text, add_special_tokens=False).ids
        b = pair.b.encode(text)
        a_bytes = [bytes(alphabet[c] for c in pair.a.id_to_token(x)) for x in a]
        pieces = [pair.b.id_to_piece(x) for x in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(x) else p.replace("▁", " ").encode()
                   for x, p in zip(b, pieces)]
        raw = (" " + text).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            continue
        links, groups, ends_a, ends_b, x, y, x0, y0 = [], [], cuts(a_bytes), cuts(b_bytes), 0, 0, 0, 0
        while x < len(a):
            links.append((a[x], b[y]))
            ea, eb = ends_a[x], ends_b[y]
            x, y = x + (ea <= eb), y + (eb <= ea)
            if ea == eb:
                groups.append(",".join(map(str, a[x0:x])) + "|" + ",".join(map(str, b[y0:y])))
                x0, y0 = x, y
        count.update(links)
        docs[-1] = (i, (len(a), len(b), groups, links))
    highest = collections.Counter()
    for (a, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[z] == highest[z[1]] for z in links),
                        sum(count[z] for z in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


DIGEST = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = ["hello", " ", "  ", "\n", "\t", "\r", ";\r", "é", "naïve", "　", "\xa0", "▁", "<|endoftext|>", "</s>",
         "don't", "123", ".", "...", "日本語", "🙂", "\x00", " ", "\x85", "\x1c", " the", " of", "fooBar",
         "é", "<unk>", "<0x0A>", "\x0b", " "]


@pytest.mark.parametrize("seed, fan, size", [(1, 128, 4 << 20), (2, 2, 60), (3, 3, 200)])
def test_alignment(spark, monkeypatch, seed, fan, size):
    """Odd white space and characters; also with many small runs and merges over several levels."""
    monkeypatch.setattr(cross_alignment, "FAN", fan)
    monkeypatch.setattr(cross_alignment, "RUN_BYTES", size)
    r = random.Random(seed)
    data = []
    for i in range(60):
        text = "".join(r.choice(PARTS) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(0, 25)))
        data.append((r.choice([None, i]), None if r.random() < 0.05 else text if r.random() < 0.2
                     else text.replace("▁", "")))
    data += data[:5]
    df = with_clashes(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(cross_alignment.align_tokenizers(df).select(DIGEST)) == aligned(data)


def test_alignment_of_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = aligned([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert rows(cross_alignment.align_tokenizers(df).select(DIGEST)) == want


def test_alignment_edge_cases(spark):
    schema = "doc_id long, text string"
    assert cross_alignment.align_tokenizers(spark.createDataFrame([], schema)).collect() == []
    data = [(1, None), (2, ""), (None, "▁"), (3, "a b " * 400_000 + "c"), (4, "x" * 20_000), (5, " "), (5, " ")]
    got = cross_alignment.align_tokenizers(spark.createDataFrame(data, schema)).select(DIGEST)
    assert rows(got) == aligned(data)


def test_merged_runs_hold_the_sums():
    tables = pa.table({"group": pa.array([0, 0, 0]), "part": pa.array([3, 3, 3], pa.int32()), "heads": pa.array([
        cross_alignment._spill(np.array(p, np.int64), np.array(n, np.int64))
        for p, n in [([1, 5, 9], [1, 2, 3]), ([], []), ([5, 10], [7, 1])]], pa.binary())})
    pairs, sums = cross_alignment._load(cross_alignment._merge(tables)["heads"][0].as_py(), 2)
    assert pairs.tolist() == [1, 5, 9, 10] and sums.tolist() == [1, 9, 3, 1]
