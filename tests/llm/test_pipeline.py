from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import common, minhash, quality, toxicity
from palimpsest.llm.common import save
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    sf = SF
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, save(f(spark, docs, sf), name)
        out[name] = (before.collect(), docs.collect(), docs.columns)
    return out


def labelled(spark, label, mod, held):
    return {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if crc32(str(r.doc_id).encode()) % mod != held}


def test_quality_and_toxicity_keep_what_a_plain_run_of_the_models_keeps(spark, stages):
    before, after, columns = stages["quality"]
    y, text = labelled(spark, "quality", 3, 1), {r.doc_id: r.text.encode() for r in before}
    ids = [d for d in text if d in y]
    m = [quality.measures(text[d]) for d in ids]
    model = quality.fit([quality.bins(x) for x in m], [x[:, 0] + 1 for x in m], np.array([y[d] for d in ids], float))
    each = {d: quality.measures(t) for d, t in text.items()}
    score = {d: model.scores(quality.Lines([quality.bins(x)]), x[:, 0] + 1)[0] for d, x in each.items()}
    kept = {r.doc_id for r in after}
    assert columns == COLUMNS and all((score[d] >= 0.5) == (d in kept) for d in score if abs(score[d] - 0.5) > 0.02)
    assert 0.7 * len(before) < len(after) < len(before)

    before, after, columns = stages["toxicity"]
    y, text = labelled(spark, "toxic", 5, 0), {r.doc_id: r.text.encode() for r in before}
    assert columns == COLUMNS and {r.doc_id for r in after} <= set(text) and len(after) > 0.8 * len(before)
    ids = sorted(d for d in text if d in y)
    letters = toxicity.trigrams(toxicity.words_of(t for d, t in text.items() if crc32(str(d).encode()) % 5))
    model = toxicity.fit([text[d] for d in ids], np.array([y[d] for d in ids], float), letters)
    score = {d: float(toxicity.sigmoid(model.totals(t) @ model.top[:-1] + model.top[-1])) for d, t in text.items()}
    assert {d for d, p in score.items() if p < 0.5} == {r.doc_id for r in after} and max(score.values()) >= 0.5


def test_one_document_of_each_group_stays(stages):
    before, after, columns = stages["near_duplicates"]
    want = [d for d, _, _, kept in brute([(r.doc_id, r.text) for r in before], 5) if kept]
    assert columns == COLUMNS and sorted(r.doc_id for r in after) == want


def test_mix_and_packing(stages):
    before, after, columns = stages["mixing"]
    size = {r.doc_id: len((r.text or "").encode().split()) for r in before}
    copies = Counter(r.doc_id for r in after)
    assert columns == COLUMNS and set(copies) <= set(size) and max(copies.values()) <= 2
    total, taken = defaultdict(int), defaultdict(int)
    for r in before:
        total[r.source] += size[r.doc_id]
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(total.values()), rel=0.02)
    before, after, _ = stages["packing"]
    check(after, [(r.doc_id, r.text) for r in before], 4096)


def test_stages_stand_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "plain words of prose here", "en", None, 5), (2, "plain words of prose here", "en", None, 5), (3, "a long text of words " * 30_000, "en", "a", 5)], schema)
    names = ["label", "score", "_score", "__score", "n", "kept", "copies", "size", "d_id", "m_id", "m_copies", "key", "again", "gone", "o_id", "row", "tie", "queue", "at", "whole", "equal", "p", "q", "a.b"]
    for docs in (odd, odd.limit(0), odd.selectExpr("*", *(f"'x' as `{n}`" for n in names))):
        for name, f in corpus_pipeline.STAGES[:4]:
            got = f(spark, docs, sf)
            assert got.columns == docs.columns and got.count() <= 2 * docs.count(), name
        pieces, want = corpus_pipeline.STAGES[4][1](spark, docs, sf), docs.count()
        assert pieces.count() >= want and pieces.where("start = 0").count() == want and pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_give_back_the_memory_of_those_before(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    full = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    for name, f in corpus_pipeline.STAGES[3:]:
        before = full()
        f(spark, docs, SF)
        assert full() > before, name


def test_near_duplicates_give_back_what_their_plans_leave_in_the_driver(spark, monkeypatch):
    """In each turn, not only before the stage: its many plans are what the driver's memory goes to."""
    eased, ease = [], minhash.ease_driver
    monkeypatch.setattr(minhash, "ease_driver", lambda s: (eased.append(s), ease(s)))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    corpus_pipeline.STAGES[2][1](spark, docs, SF).count()
    assert len(eased) >= 2


def test_the_driver_gives_back_native_memory(spark):
    assert "Trim native heap" in common.trim_jvm(spark)


def test_near_duplicates_lose_no_text_to_ids_that_repeat(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(0, text["a"], "de"), (0, text["b"], "de"), (0, text["b"], "en"), (None, text["c"], "fr"), (None, text["c"], "fr"), (None, text["d"], "fr"), (5, text["a"] + " more", "de"), (6, "other words entirely, six of them", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d_id string")
    got = corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()
    assert got[0].__fields__ == docs.columns
    texts = sorted(r.text[:2] for r in got)
    assert texts == sorted(t[:2] for t in [text["a"], text["b"], text["c"], text["d"], "ot"])
