import math
from collections import Counter
from itertools import product
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hmm
from palimpsest.llm.common import id_crc
from palimpsest.llm.hmm import Model, expected, likelihoods, op2_hmm, score


def small(states=3, symbols=4):
    rng = np.random.default_rng(3)
    p = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1])
    return Model(p(states), p(states, states), p(states, symbols).T.copy())


def by_paths(m, seq):
    """Probability, and expected counts, by summing over every path of states."""
    s = len(m.start)
    total, move, emit, start = 0.0, np.zeros((s, s)), np.zeros(m.emit.shape), np.zeros(s)
    for path in product(range(s), repeat=len(seq)):
        p = m.start[path[0]] * math.prod(m.emit[x, z] for x, z in zip(seq, path)) * math.prod(m.move[a, b] for a, b in zip(path, path[1:]))
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for x, z in zip(seq, path):
            emit[x, z] += p
    return total, start / total, move / total, emit / total


def test_recursions_equal_sums_over_paths():
    m, seqs = small(), [np.array(x) for x in ([1, 2, 3, 0, 1], [0], [2, 2], [3, 1, 0, 2])]
    want = [by_paths(m, s) for s in seqs]
    assert np.allclose(likelihoods(m, seqs), [math.log(w[0]) for w in want])
    got = expected(m, seqs)
    for k in range(3):
        assert np.allclose(got[k], sum(w[k + 1] for w in want))


@pytest.mark.parametrize("size", [1, 2, 3])
def test_states_are_carried_from_run_to_run(monkeypatch, size):
    """However sequences are cut into runs, likelihoods and expected counts are those of whole sequences."""
    m, rng = small(), np.random.default_rng(8)
    seqs = [rng.integers(0, 4, k) for k in (1, 2, 3, 5, 7, 7, 1)]
    want, whole = likelihoods(m, seqs), expected(m, seqs)
    monkeypatch.setattr(hmm, "RUN", size)
    assert np.allclose(likelihoods(m, seqs), want)
    assert all(np.allclose(a, b) for a, b in zip(expected(m, seqs), whole))
    assert np.allclose(likelihoods(m, [np.tile([0, 1, 2, 3], 500)] * 2), hmm.Runs([np.tile([0, 1, 2, 3], 500)] * 2, 10**6).entered(m)[1])


def test_expected_counts_read_a_sequence_of_one_run_once(monkeypatch):
    """Only sequences of several runs are read forward before their counts: those of one run carry no states over."""
    m, seqs, read = small(), [np.array(x) for x in ([1, 2], [3, 1, 0, 2, 2], [0], [2, 3, 1])], []
    whole = expected(m, seqs)
    forward = hmm._forward
    monkeypatch.setattr(hmm, "_forward", lambda m, runs, enter: (read.extend(x.tolist() for x in runs), forward(m, runs, enter))[1])
    monkeypatch.setattr(hmm, "RUN", 3)
    assert all(np.allclose(a, b) for a, b in zip(expected(m, seqs), whole)) and read == [[3, 1, 0]]
    assert all(np.allclose(a, b) for a, b in zip(expected(m, seqs[2:]), expected(m, [*seqs[3:], *seqs[2:3]]))) and read == [[3, 1, 0]]


def test_scaling_now_and_then_loses_nothing(monkeypatch):
    """Symbols as unlikely as any of a huge vocabulary give the same counts, scaled at each step or not."""
    m, rng = small(symbols=6), np.random.default_rng(5)
    m = Model(m.start, m.move, m.emit * np.array([1, 1e-17, 1, 1e-17, 1e-12, 1])[:, None])
    seqs = [rng.integers(0, 6, k) for k in (1, 8, 9, 40, 41, 300)] + [np.ones(50, int)]
    got, logs = expected(m, seqs), likelihoods(m, seqs)
    assert all(g.sum() == pytest.approx(n) for g, n in zip(got, (len(seqs), sum(map(len, seqs)) - len(seqs), sum(map(len, seqs)))))
    monkeypatch.setattr(hmm, "SCALED", 1)
    assert np.allclose(likelihoods(m, seqs), logs, rtol=1e-12) and all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(expected(m, seqs), got))


def plain_scores(texts, held, starts):
    """What the query does, with one dictionary, one list of texts and no partitions."""
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    c, train = Counter(), [d for d in sorted(texts) if not held[d]]
    for d in train:
        c.update(words[d])
    best = sorted((w for w in c if c[w] >= hmm.LEAST), key=lambda w: (-c[w], hmm._hash(w)))[: hmm.TOP]
    symbol = {w: k + 2 for k, w in enumerate(best)}
    seq = {d: np.array([*(symbol.get(x, 1) for x in words[d]), 0]) for d in texts}
    rare_c, rare_v = sum(c.values()) - sum(c[w] for w in best), len(c) - len(best)
    unigram = np.array([len(train) + 1, rare_c + 1, *(c[w] + 1.0 for w in best)])
    unigram /= unigram.sum()
    m = Model.random(unigram, hmm.STATES)
    for few in [[d for d in train if starts[d]]] * hmm.START_PASSES + [train] * hmm.PASSES:
        m = Model.of_counts(*(expected(m, [seq[d] for d in few]) if few else (np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((len(unigram), hmm.STATES)))), unigram)
    rare = {d: sum(math.log10((c[x] + 1) / (rare_c + rare_v + 1)) for x in words[d] if x not in symbol) for d in texts}
    ids = list(texts)
    return dict(zip(ids, likelihoods(m, [seq[d] for d in ids]) / math.log(10) + [rare[d] for d in ids]))


def test_query_scores_equal_a_plain_run(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (id_crc("doc_id", 7) == 2).alias("held"), (F.pmod(F.xxhash64("doc_id"), F.lit(hmm.START_SHARE)) == 0).alias("start")).collect()
    want = plain_scores({r.doc_id: r.text for r in rows}, {r.doc_id: r.held for r in rows}, {r.doc_id: r.start for r in rows})
    got = {r.doc_id: r.score for r in op2_hmm(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)


def test_every_pass_reads_every_training_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("doc_id", "text", (id_crc("doc_id", 7) == 2).alias("held")).collect()
    want = plain_scores({r.doc_id: r.text for r in rows}, {r.doc_id: r.held for r in rows}, {r.doc_id: True for r in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in score(docs, F.col("held")).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)


def test_passes_leave_no_files_to_later_ones(spark, sf, monkeypatch):
    """Each pass begins without the shuffle files of those before it, and without the counts that only the encoding reads."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    kept = lambda: {f.name.split("_")[1] for d in dirs for f in Path(str(d)).rglob("shuffle_*")}
    first, left, dropped, expect, drop = [], [], [], hmm._expect, hmm.drop
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)

    def watched(model, states):
        first.extend([] if first else [kept()])
        left.append(kept() - first[0])
        return expect(model, states)

    monkeypatch.setattr(hmm, "_expect", watched)
    monkeypatch.setattr(hmm, "drop", lambda *t: (dropped.extend(t), drop(*t)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    assert score(docs, id_crc("doc_id", 7) == 2, passes=0).count() == 40
    assert left == [set()] * hmm.START_PASSES and [t.columns for t in dropped] == [["hash", "c"]] and spark.conf.get(name, None) == before


def test_query_counts_and_base(spark, sf):
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c, train = Counter(), [d for d in docs if crc32(str(d).encode()) % 7 != 2]
    for d in train:
        c.update(docs[d])
    end, n, v = len(train), sum(c.values()) + len(train), len(c) + 1
    got = op2_hmm(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        w = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id not in set(train), len(w) + 1, n)
        assert r.n_known == sum(c[x] > 0 for x in w) + 1
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((end + 1) / (n + v + 1)))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_joined_words_score_as_broadcast_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    a, b = ({r.doc_id: r for r in score(docs, id_crc("doc_id", 7) == 2, top=50, passes=1, broadcast_words=k).collect()} for k in (10**6, 0))
    assert a.keys() == b.keys()
    for d in a:
        assert a[d].n_known == b[d].n_known and a[d].score == pytest.approx(b[d].score) and a[d].base_score == pytest.approx(b[d].base_score)


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "Ä ä a A", 3), (3, "word " * 3000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = score(df, id_crc("doc_id", 7) == 2).collect()
    assert len(got) == 5 and all(np.isfinite(r.score) and r.score <= 0 for r in got) and sorted(r.n_tokens for r in got) == [1, 1, 1, 5, 3001]
    assert score(df.limit(0), F.lit(False)).count() == 0
    assert all(np.isfinite(r.score) for r in score(df, F.lit(True)).collect())
