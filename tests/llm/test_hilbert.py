from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm.hilbert import curve, op9_hilbert, search


def test_neighbouring_places_are_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curve(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute(rows, k=10):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, a in ok:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in ok if i != q and len(a) == len(b))
            out[q] = d[:k]
    return out


def test_whole_table_against_brute_force(spark, sf):
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    got = defaultdict(list)
    for r in op9_hilbert(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    true = {(q, i): s for q, v in want.items() for s, i in v}
    assert all(abs(true[q, i] - s) < 1e-12 for q, v in got.items() for s, i in v if (q, i) in true)


def test_whole_tables_equal_sql(spark):
    """All queries of this subpackage that have SQL, the one of the vectors at two sizes."""
    import duckdb

    from palimpsest.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, d)
        want = c.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key), name


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (100, [1.0, 0.0, 0.0]), (200, [None, 1.0]), (None, [1.0, 1.0]), (300, [0.0, 2.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in search(df, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 1.0), (300, 1, 0, 2.236068), (300, 2, 1, 2.236068), (300, 3, 2, 2.236068)]
    assert search(df.limit(0), F.lit(True)).count() == 0
    many = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(250)] + [(1000 + i, [float(i), 2.0], 0) for i in range(40)], "vec_id long, embedding array<double>, rank int")
    near = search(many, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [r.vec_id for r in near] == list(range(10)) and all(r.score == 0 for r in near)


def test_ties_at_the_last_place_go_to_smaller_ids(spark):
    """Sixty different vectors at one distance: more than any block keeps by approximate distances."""
    rows = [(0, [0.0] * 59 + [1.0])] + [(1000 + i, [3.0 if j == i else 0.0 for j in range(59)] + [1.0]) for i in range(59)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1000, 1010)) and all(r.score == 3.0 for r in got)


def test_windows_in_rows_find_what_they_are_made_for(spark, monkeypatch):
    from palimpsest.llm import hilbert

    for name, value in (("SMALL", 10), ("LEAST_WINDOW", 4), ("BLOCK", 64)):
        monkeypatch.setattr(hilbert, name, value)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(200, 12)), 15, axis=0) + 0.2 * rng.normal(size=(3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = defaultdict(set)
    for r in search(df, F.col("vec_id") % 20 == 0, orderings=12).collect():
        got[r.query_id].add(r.vec_id)
        assert r.recall >= 0.85
    hits = 0
    for q in range(0, 3000, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 1500
