import random
from itertools import combinations

import numpy as np

from palimpsest.llm import minhash
from palimpsest.llm.common import components
from palimpsest.llm.minhash import RUN, SHARED, SKETCH, near_duplicates, op1_minhash

DOCS = "doc_id long, text string, n long, rep string"


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, percent=80):
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return sorted((d, len(s), root(d), d == root(d)) for d, s in sets)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op1_minhash(spark, sf)) == brute(docs, 2)


def test_groups_of_near_copies_and_a_common_passage(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, docs = " ".join(word() for _ in range(60)), []
    for size, edits in ((40, 3), (25, 12), (12, 18), (6, 1), (3, 1)):  # copies edited in so many places; some near the threshold
        base = [word() for _ in range(size * 8)]
        for _ in range(size):
            w = list(base)
            for i in rng.sample(range(len(w)), min(edits, len(w))):
                w[i] = word()
            docs.append(" ".join(w))
    docs += [f"{passage} " + " ".join(word() for _ in range(50)) for _ in range(60)]
    docs += [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(4)]
    docs += ["a b c d e", "a b c d e f", "a b c d", "A B C D", "", " \t", None, "x"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    assert rows(near_duplicates(spark.createDataFrame([(d, t, 7, None) for d, t in docs], DOCS), words=2)) == brute(docs, 2)
    assert rows(near_duplicates(spark.createDataFrame([(d, t, 7, None) for d, t in docs], DOCS))) == brute(docs, 5)
    # straight to the last turn, in small blocks
    monkeypatch.setattr(minhash, "TURNS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert rows(near_duplicates(spark.createDataFrame([(d, t, 7, None) for d, t in docs], DOCS), words=2)) == brute(docs, 2)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c", 1, ""), (None, "a b c", 1, ""), (3, "a b c", 1, ""), (3, "a b c", 1, ""), (3, "d e f g", 1, ""), (2, "d e f g", 1, "")], DOCS)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(df, 2).collect())
    assert got == [("2", 3, "2", True), ("3", 2, "2", False), ("3", 2, "2", False), ("3", 3, "2", False), ("None", 2, "None", True), ("None", 2, "None", True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 50)] + [(7, 3), (7, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in [5, *range(10, 50)]) and got[9] == 3


def test_pairs_at_the_threshold_share_enough_runs():
    """The number of shared runs that the lists rely on, for similarity 0.8 exactly."""
    ok = np.random.default_rng(1).random((200_000, SKETCH)) < 0.8
    runs = np.ones((len(ok), SKETCH - RUN + 1), bool)
    for i in range(RUN):
        runs &= ok[:, i : SKETCH - RUN + 1 + i]
    assert (runs.sum(1) < SHARED).mean() < 5e-5
