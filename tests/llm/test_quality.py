from itertools import product

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm.common import id_crc
from palimpsest.llm.quality import BINS, EDGES, Lines, bins, classify, measures, op7_quality


def test_marginals_equal_sums_over_labellings():
    rng = np.random.default_rng(2)
    each = [rng.integers(0, 3, (n, len(EDGES))).astype(np.uint8) for n in (3, 1, 5)]
    lines = Lines(each)
    w, pair = rng.normal(size=lines.width) / 3, rng.normal(size=(2, 2))
    got, moves = lines.marginals(w, pair)
    want, want_moves = np.zeros(len(got)), np.zeros((2, 2))
    for b, start in zip(each, lines.starts):
        n, total, part, pm = len(b), 0.0, np.zeros(len(b)), np.zeros((2, 2))
        pot = w[lines.index[start : start + n]].sum(1)
        for y in product((0, 1), repeat=n):
            p = np.exp(sum(pot[i] * y[i] for i in range(n)) + sum(pair[a, c] for a, c in zip(y, y[1:])))
            total += p
            part += p * np.array(y)
            for a, c in zip(y, y[1:]):
                pm[a, c] += p
        want[start : start + n] = part / total
        want_moves += pm / total
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_neighbours_are_features():
    lines = Lines([np.zeros((2, len(EDGES)), np.uint8)])
    assert lines.index.shape == (2, 3 * len(EDGES)) and lines.index.max() < lines.width and BINS == max(map(len, EDGES)) + 1
    assert bins(measures(b"a b\n\n" + b"x" * 5000)).shape == (3, len(EDGES))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op7_quality(spark, d).collect()
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 50_000, 3), (3, "\n\n", 4)], "doc_id long, text string, quality int")
    some = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 0)], "doc_id long, quality int")
    got = classify(docs, some, F.lit(False)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classify(docs, some.limit(0), id_crc("doc_id", 3) == 1).collect()} == {0.5}
    assert classify(docs.limit(0), some, F.lit(False)).count() == 0
