"""The operators on documents: against brute force on whole small tables, and their edge cases."""

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from shiftlab.llm import (exact_dedup, mixing, near_dedup, packing, quality, shingles, token_files, token_ids,
                          toxicity)
from shiftlab.llm.common import components, maybe_in, table

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _sha long, _keep string, "
          "_filter_bits int, _tokens int")
ODD = [(1, None, None, None, None, 7, "x", 0, 1), (2, "", "en", "a", 0, 7, "x", 1, 1),
       (3, "same text here for all of us", "en", "a", 28, 7, None, 1, 1),
       (4, "same text here for all of us", None, "b", 28, 8, "y", 0, 2),
       (4, "same text here for all of us", None, "b", 28, 8, "y", 0, 2),
       (5, " \n\t ", "de", "b", 4, 9, "y", 0, 2), (None, "no id", "de", "b", 5, 9, "y", 0, 2),
       (6, "long " * 30_000 + "end", "en", "a", 150_003, 1, "z", 1, 3), (7, "﻿é <|endoftext|> ### 12", "fr", "c", 9, 1, "z", 1, 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF_SMALL, "documents")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_ids.vocabulary_path())


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# --- helpers -----------------------------------------------------------------

def test_filter_keeps_all_keys_and_few_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 97 != 0, F.col("id")).alias("k"), F.lit(1).alias("_filter_bits"))
    got = maybe_in(rows, F.col("k"), spark.range(0, 5000, 10).toDF("key"))
    ids = {r["k"] for r in got.collect()}
    wanted = {k for k in range(0, 5000, 10) if k % 97}
    assert wanted <= ids and len(ids) < len(wanted) + 10 and got.columns == rows.columns
    assert maybe_in(rows, F.col("k"), spark.range(0).toDF("key")).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (205, 203), (203, 204)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({i: 1 for i in range(1, 41)} | {100 + k: 100 for k in range(50)} | {203: 203, 204: 203, 205: 203})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(
    alphabet="aB É'.,!?<|>end oftx12\n\t\x85́#", max_size=80)), max_size=8))
def test_ids_by_word_are_those_of_whole_texts(tokenizer, texts):
    e = token_ids.encoder(token_ids.vocabulary_path())
    ids, n = e.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][:len(texts)] == [whole(tokenizer, t) for t in texts]


def test_word_table_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(token_ids, "MAX_WORDS", 5)
    e = token_ids.Encoder(token_ids.vocabulary_path())
    for t in ["one two three.", "four five six seven", "one eight nine, ten eleven twelve"]:
        assert e.encode(pa.array([t]))[0].tolist() == whole(tokenizer, t)


# --- 1: token files ----------------------------------------------------------

@given(st.lists(st.integers(0, 3000), max_size=700))
@settings(max_examples=40, deadline=None)
def test_elias_fano_round_trip(lengths):
    ends = np.cumsum(np.array(lengths, np.int64))
    ids = np.arange(int(ends[-1]) if lengths else 0) % 70_000
    s = token_files.Segment(token_files.segment_bytes(list(range(len(lengths))), ends, ids))
    assert s.ends.select_all().tolist() == ends.tolist() and s.ids.tolist() == ids.tolist()
    for i in range(0, len(lengths), 37):
        assert s.ends.select(i) == ends[i]
        assert s.document(i).tolist() == ids[ends[i] - lengths[i]:ends[i]].tolist()
    bits = 8 * (len(s.ends.low) + len(s.ends.high) + len(s.ends.samples))
    assert bits <= len(lengths) * (2 + np.log2(max(1, len(ids)) / max(1, len(lengths)) + 1) + 1) + 100


def expected_tokens(tokenizer, rows, end_id):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole(tokenizer, t), end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_token_files_hold_every_document(spark, documents, odd, tokenizer, small, monkeypatch):
    if small:
        monkeypatch.setattr(token_files, "SEGMENT_IDS", 1000)
    docs = odd if small else documents
    got = token_files.read_token_files(*token_files.write_token_files(docs))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected_tokens(tokenizer, rows, 2), key=key)


def test_token_files_of_nothing(empty):
    folder, manifest = token_files.write_token_files(empty)
    assert manifest.count() == 0 and token_files.read_token_files(folder, manifest).count() == 0


# --- 2: near duplicates --------------------------------------------------------

def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, width):
    sets = {d: shingle_set(t, width) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in itertools.combinations(sorted(d for d in sets if sets[d]), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {(d, len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, documents, width):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {tuple(r) for r in near_dedup.near_duplicates(documents, width=width).collect()}
    assert got == brute_near(rows, width)


def test_near_duplicates_in_hot_groups(spark, monkeypatch):
    """Near copies of one text at many distances, whose smallest id is an outlier; small tiles."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join([*base[:95], *(f"z{i}" for i in range(25))]))]
    for d in range(1, 70):
        w = list(base)
        for i in r.choice(120, int(r.integers(0, 7)), replace=False):
            w[i] = f"c{d}x{i}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, "same short text") for d in range(30)]
    got = {tuple(x) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute_near(rows, 4)


def test_near_duplicates_edge_cases(odd, empty):
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(ODD) and by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[5] == (0, 5, True)
    assert by[3] == (3, 3, True) and by[4] == (3, 3, False) and by[None] == (1, None, True) and by[6][0] == 2
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity_and_fills_every_bin():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b, one = np.sort(x[:800]), np.sort(x[100:]), x[:1]
    s = shingles.sketches(np.concatenate([a, b, one]), np.array([800, 800, 1]), 512)
    assert (s != shingles._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.08 and (s[2] == s[0]).mean() < 0.1
    assert (shingles.sketches(a, np.array([800]), 512)[0] == s[0]).all()


# --- 3: packing ----------------------------------------------------------------

def check_packing(rows, docs, tokenizer, capacity, end_id):
    expected = {}
    for d, t in docs:
        ids = [*whole(tokenizer, t), end_id]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            key = (d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            expected[key] = expected.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_of_documents(documents, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    used, least = check_packing(packing.pack_documents(documents).collect(), docs, tokenizer, 4096, 1)
    assert used <= least + 1


def test_packing_edge_cases(odd, empty, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 2)
    rows = packing.pack_documents(odd, capacity=64, with_ids=True).collect()
    check_packing(rows, [(r[0], r[1]) for r in ODD], tokenizer, 64, 1)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=14))
def test_plan_uses_every_piece_and_stays_near_the_bound(histogram):
    plan = packing.plan(histogram, 40)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 40 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    first_fit = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        i = next((i for i, s in enumerate(first_fit) if s + x <= 40), None)
        if i is None:
            first_fit.append(x)
        else:
            first_fit[i] += x
    assert sum(t for _, t in plan) <= len(first_fit)


def test_completion_finds_a_filling_that_best_fit_misses():
    pattern = packing.best_completion(10, [7, 6, 4, 2], np.array([1, 1, 1, 1]), 1000)
    assert sum([7, 6, 4, 2][i] for i in pattern) == 10


# --- 6, 8: classifiers -----------------------------------------------------------

def held(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


@pytest.mark.parametrize("name, least", [("quality", 0.97), ("toxicity", 0.93)])
def test_held_out_accuracy(spark, name, least):
    module, label, fold = {"quality": (quality, "quality", (3, 1)), "toxicity": (toxicity, "toxic", (5, 0))}[name]
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    model = module.learn(docs, labels, fold)
    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    got = {r["doc_id"]: r for r in score(docs, model, fold).collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == held(d, *fold) for d, r in got.items())
    out = [(got[d]["predicted"], y) for d, y in truth.items() if held(d, *fold)]
    assert sum(p == y for p, y in out) / len(out) >= least


def test_classifier_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    net, model = quality.learn(odd, labels), toxicity.learn(odd, labels.limit(0))
    for got in (quality.score_quality(odd, net), toxicity.score_toxicity(odd, model)):
        rows = got.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    assert quality.score_quality(empty, net).count() == 0 and toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.drop_toxic(odd, model).count() == len(ODD) and toxicity.drop_toxic(odd, model).columns == odd.columns


def test_network_gradients():
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b1"] += 0.05                                    # padding not at the kink
    data = np.random.default_rng(2).integers(97, 123, 1400).astype(np.uint8).tobytes()
    docs = [quality.chunks(data), quality.chunks(b"### some more")]
    y, w = np.array([1.0, 0.0]), np.ones(2)
    g, _ = net.gradients(docs, y, w)
    for k, place in (("w1", (3, 2)), ("b1", (1,)), ("w2", (4, 3)), ("w3", (2,)), ("emb", (ord("e"), 1))):
        e, keep = 1e-6, net.p[k][place]
        net.p[k][place] = keep + e
        up = net.gradients(docs, y, w)[1]
        net.p[k][place] = keep - e
        down = net.gradients(docs, y, w)[1]
        net.p[k][place] = keep
        assert g[k][place] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-7)


def test_chunks_cover_the_whole_text():
    data = bytes(i % 251 for i in range(3000))
    c = quality.chunks(data)
    assert c.shape[1] == quality.CHUNK and c[0][:10].tolist() == list(range(10))
    assert sum((c == 512).sum(axis=1) < quality.CHUNK) == len(c) and (c[-1][c[-1] < 512] % 256)[-1] == 2999 % 251
    repeated = quality.symbols(b"word word word word")
    assert (repeated[:12] < 256).all() and (repeated[12:] >= 256).all()


def test_grammar_classes():
    model = toxicity.Model({"idiot": 1.0, "stup*": 0.8})
    by = lambda s: dict(zip(toxicity.CLASSES, model.sums(s)))
    assert by("what an Idiot. fine") == {"plain": 1, "aimed": 0, "negated": 0, "reported": 0, "threat": 0}
    assert by("you are stupid")["aimed"] == pytest.approx(0.8) and by("he is not an idiot")["negated"] == 1
    assert by("she said the idiot")["reported"] == 1 and by("we will kill you")["threat"] == 1
    assert by("we will not kill time")["threat"] == 0 and sum(by("idiotic stup").values()) == 0
    assert by("you. idiot, idiot")["plain"] == 2 and sum(by("").values()) == 0


def test_clauses_are_read_from_their_start():
    model, far = toxicity.Model({"idiot": 1.0}), "word " * 2000
    by = lambda s: dict(zip(toxicity.CLASSES, model.sums(s)))
    assert by(f"she said {far} idiot")["reported"] == 1 and by(f"you {far} idiot")["aimed"] == 1
    assert by(f"we will {far} kill you")["threat"] == 1 and by(f"she said, {far} idiot")["plain"] == 1
    assert by(f"you {far} idiot, {far} idiot. {far}") == {"plain": 1, "aimed": 1, "negated": 0, "reported": 0, "threat": 0}


def test_texts_that_share_words_count_each(spark):
    shared = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    toxic = [(f"{shared} own{name(i)} {'zorkle' if i < 8 else 'snib' + name(i)}", 1) for i in range(40)]
    clean = [(f"{shared} own{name(i)}", 0) for i in range(100, 400)]
    copies = [("Vrumpf " + " ".join(reversed(shared.split())), 1), (f"{shared} vrumpf", 1)] * 5
    model = toxicity.fit(spark.createDataFrame(toxic + clean + copies, "text string, label int"))
    assert model.terminals["zorkle"] > 0 and "vrumpf" not in model.terminals
    assert len({toxicity._terminals(t)[1] for t, _ in toxic + clean}) == 340


# --- 7: exact duplicates ----------------------------------------------------------

def test_exact_duplicates_edge_cases(spark, odd, empty):
    prefix = "p" * 400
    more = spark.createDataFrame([(21, prefix + "a"), (22, prefix + "b"), (23, prefix + "a"), (24, prefix + "aa")],
                                 "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = exact_dedup.exact_duplicates(docs).collect()
    for r in got:
        same = [d for d, t in rows if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        ids = [d for d in same if d is not None]
        assert r["group_size"] == len(same) and r["keep_id"] == (max(ids) if ids else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({t for _, t in rows})
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5, None, 6, 7, 22, 23, 24}
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


# --- 9: mixing ---------------------------------------------------------------------

def test_raking_meets_given_and_tempered_marginals(spark):
    docs = table(spark, SF_MID, "documents")
    langs = spark.createDataFrame([("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)], "lang string, share double")
    got = mixing.mix_documents(docs, targets={"lang": langs}, exponents={"source": 0.5, "topic": 1.0}).toPandas()
    got["w"] = got["n_tokens"] * got["factor"]
    total = got["n_tokens"].sum()
    assert got["w"].sum() == pytest.approx(total, rel=1e-6) and got["probability"].max() == 1
    assert (got.groupby("lang")["w"].sum() / total).to_dict() == pytest.approx({"en": .4, "de": .3, "fr": .2, "es": .1}, rel=1e-5)
    s = got.groupby("source")["n_tokens"].sum() ** 0.5
    assert (got.groupby("source")["w"].sum() / total).to_dict() == pytest.approx((s / s.sum()).to_dict(), rel=1e-5)
    t = got.groupby("topic")["n_tokens"].sum() / total
    assert (got.groupby("topic")["w"].sum() / total).to_dict() == pytest.approx(t.to_dict(), rel=1e-5)
    drawn = got[got["selected"]].groupby("lang")["n_tokens"].sum()
    assert abs(drawn["en"] / drawn.sum() - 0.4) < 0.15


def test_mixing_edge_cases(odd, empty):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == len(ODD) and all(0 < r["probability"] <= 1 for r in rows) and any(r["selected"] for r in rows)
    kept = mixing.sample_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["selected"] for r in rows)
    assert mixing.mix_documents(empty).count() == 0 and mixing.sample_documents(empty).count() == 0


def test_a_rare_source_does_not_shrink_the_draw(spark):
    import corpus_pipeline
    rows = [(i, "word " * 80, "en", f"s{i % 4}") for i in range(4000)] + [(9001, "word " * 80, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for kept in (mixing.sample_documents(docs, least=0.75), corpus_pipeline.mixing_stage(spark, docs, "")):
        assert kept.columns == docs.columns
        got = kept.groupBy("source").count().collect()
        share = {r["source"]: r["count"] / kept.count() for r in got}
        weights = {**{f"s{k}": 1000 ** 0.7 for k in range(4)}, None: 1}
        assert share == pytest.approx({k: w / sum(weights.values()) for k, w in weights.items()}, rel=0.05)
        assert kept.count() == pytest.approx(4001, rel=0.02)
        assert kept.distinct().count() >= 0.95 * 4001


def test_mixing_plan_is_native(spark, odd):
    plan = mixing.mix_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
