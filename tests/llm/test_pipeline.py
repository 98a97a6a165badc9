"""The corpus pipeline, stage by stage, against brute-force versions on whole small tables."""

import importlib.util
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_MID
from shiftlab.llm import mixing, toxicity
from shiftlab.llm.common import saved, table
from test_text_operators import brute_near, check_packing, tokenizer  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_MID, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF_MID), name)
        out.append((docs, after))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_keep_the_columns_and_rows_as_they_were(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes and set(rows(after)) <= set(rows(before)) and after.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages["toxicity"]
    left = {r["doc_id"] for r in after.collect()}
    model = toxicity.learn(before, table(spark, SF_MID, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(before, model).collect()}
    assert left == {d for d, s in scores.items() if s < 0.5}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF_MID, "labels").collect()}
    clean, toxic = [d for d, t in labels.items() if not t], [d for d, t in labels.items() if t]
    assert sum(d in left for d in clean) >= 0.99 * len(clean) and sum(d in left for d in toxic) <= 0.4 * len(toxic)


def test_one_row_of_each_group_of_copies_stays(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {(r["text"], r["doc_id"]) for r in after.collect()} == set(best.items())
    before, after = stages["near_dedup"]
    kept = {d for d, _, _, k in brute_near([(r["doc_id"], r["text"]) for r in before.collect()], 5) if k}
    assert {r["doc_id"] for r in after.collect()} == kept


def test_the_draw_is_that_of_the_calibrated_probabilities(stages):
    before, after = stages["mixing"]
    chosen = {r["doc_id"] for r in mixing.mix_documents(before).where("selected").collect()}
    assert {r["doc_id"] for r in after.collect()} == chosen


def test_packed_pieces_hold_every_document(stages, tokenizer):  # noqa: F811
    before, after = stages["packing"]
    used, least = check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], tokenizer, 4096, 1)
    assert used <= least + 1


def test_stages_on_nothing_and_on_odd_rows(spark):
    docs = table(spark, SF_MID, "documents").limit(0)
    odd = docs.unionByName(spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_MID).count() == 0
        assert stage(spark, odd, SF_MID).count() >= 1


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as E
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()
    assert sum(n.startswith("op") for n in E.queries()) == 13
    for name in [m for m in sys.modules if m.startswith("shiftlab.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "shiftlab.llm") or name.startswith("shiftlab.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    spec = importlib.util.spec_from_file_location("entry_without", E.__file__)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert "pipeline" not in module.queries() and not any(n.startswith("op") and n[2].isdigit() for n in module.queries())
    assert "accuracy_by_split" in module.queries() and F is not None
