import numpy as np
import pytest

from palimpsest.llm import graph
from palimpsest.llm.graph import Cells, near_duplicates, op8_graph, prune, search
from palimpsest.llm.vectors import unit


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = {i: 0 for i, _ in ok}, {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(ok):
        for j, b in ok[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                n[i] += 1
                n[j] += 1
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return sorted((i, n.get(i, 0), root(i), root(i) == i) for i, _ in rows if i is not None)


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op8_graph(spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)


@pytest.fixture(scope="module")
def groups():
    """Groups of near copies, some at the threshold, a hot one with equal vectors, and vectors on their own."""
    rng, rows = np.random.default_rng(0), []
    for k in range(40):
        base = rng.normal(size=16)
        rows += [(base + (0.05 + 0.005 * k) * rng.normal(size=16)).tolist() for _ in range(8)]
    hot = rng.normal(size=16)
    rows += [(hot + 0.05 * rng.normal(size=16)).tolist() for _ in range(260)] + [hot.tolist()] * 40 + rng.normal(size=(100, 16)).tolist()
    rows = list(enumerate(rows))
    return rows, brute(rows)


@pytest.mark.parametrize(("shard", "most", "block"), [(60, 80, 8192), (60, 50, 37), (5000, 90, 64)])
def test_groups_over_several_shards(spark, monkeypatch, groups, shard, most, block):
    for name, value in (("SHARD", shard), ("MOST", most), ("BLOCK", block)):
        monkeypatch.setattr(graph, name, value)
    rows, want = groups
    got = sorted(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r.vec_id)
    assert all(r.n_links <= w[1] for r, w in zip(got, want)) and sum(r.n_links for r in got) >= 0.99 * sum(x[1] for x in want)
    assert sum(r.component_id == w[2] for r, w in zip(got, want)) >= 0.98 * len(want)
    assert got[0].recall is not None and got[0].recall >= 0.98


def test_comparing_all_blocks_is_exact(spark, monkeypatch, groups):
    """The way out where the graph's recall stays low."""
    monkeypatch.setattr(graph, "MOST", 90)
    monkeypatch.setattr(graph, "BLOCK", 100)
    rows, want = groups
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), overlap=0).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_shards_stay_small_however_many_vectors_there_are():
    x = unit(np.random.default_rng(3).normal(size=(4000, 32)))
    cells = Cells(x, 40_000_000, 3)
    rows, cluster, code = cells.of(x)
    each = np.unique(np.column_stack([cluster, code]), axis=0, return_counts=True)[1]
    assert cells.bits.min() >= 4 and each.max() * 10_000 < 30 * 10_000 and len(rows) <= 6 * len(x)
    # near copies share a cell
    y = unit(x + 0.03 * np.random.default_rng(4).normal(size=x.shape))
    of = lambda z: {(r, c, k) for r, c, k in zip(*cells.of(z))}
    assert len({t[0] for t in of(x) & of(y)}) >= 0.97 * len(x)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 0.0]), (None, [1.0, 0.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in near_duplicates(df).collect())
    assert got == sorted([("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), ("3", 0, "3"), ("4", 0, "4"), ("5", 0, "5"), ("6", 0, "6"), ("7", 0, "7"), ("8", 0, "8"), ("9", 0, "9"), ("None", 0, "None"), ("10", 1, "10"), ("11", 1, "10")])
    assert near_duplicates(df.limit(0)).count() == 0


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(4)
    x = unit(np.repeat(rng.normal(size=(60, 24)), 5, axis=0) + 0.1 * rng.normal(size=(300, 24)))
    sim = x @ x.T
    near = prune(sim)
    assert near.shape[1] <= graph.DEGREE
    got, want = search(sim, near), (sim >= 0.95) & ~np.eye(300, dtype=bool)
    assert not (got & ~want).any() and got.sum() >= 0.99 * want.sum()
