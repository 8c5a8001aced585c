"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are projected onto a few random directions, once for each of several orderings, shifted, and numbered along a
Hilbert curve. All orderings are range-partitioned and sorted by these keys, so that every vector has a place in each; rows
carry their vectors in a byte a component, with the error that this makes. A query looks at the rows within a window of
its place in every ordering; whatever the errors leave possible among its nearest is merged over all orderings and ranked
by exact distances. How wide windows are follows from the places of true neighbours of some vectors, in rows; an audit on
other vectors measures what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import save, smallest, table
from palimpsest.llm.vectors import against_all, classes, sample

#: Orderings, directions and bits of each. Many narrow windows find more than few wide ones of as many rows.
ORDERINGS, DIRECTIONS, BITS = 48, 16, 3
#: Vectors that projections are fitted on, queries whose neighbours say how wide windows are and those that the audit takes,
#: the share of neighbours that windows are made for.
SAMPLE, PILOT, AUDIT, RECALL = 10_000, 200, 100, 0.95
#: Rows to a side of a window at least, rows of a block at least, vectors of a dimension up to which windows hold them all.
LEAST_WINDOW, BLOCK, SMALL = 64, 4_096, 1_000

LAID = "dim int, ordering int, key long, cid long, code binary, err float, asked boolean"


def curve(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates below 2**bits (points x directions).

    Coordinates are turned, bit plane by bit plane from the top, into the frame of the curve's cell; the Gray code of
    the planes is the place.
    """
    x = x.T.astype(np.int64)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in x:
            upper = (axis >> b) & 1
            swap = np.where(upper == 0, (x[0] ^ axis) & low, 0)
            if axis is not x[0]:
                axis ^= swap
            x[0] ^= np.where(upper == 1, low, swap)
    x = np.bitwise_xor.accumulate(x, axis=0)
    last, turn = x[-1], np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((last >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


class Curves:
    """Directions, scales and shifts of all orderings of a dimension, and how its vectors are written as bytes."""

    def __init__(self, x: np.ndarray, orderings: int):
        rng, dim = np.random.default_rng(5), x.shape[1]
        p = min(DIRECTIONS, dim)
        self.centre = x.mean(0)
        self.step = max(float(np.quantile(np.abs(x - self.centre), 0.9999)) / 127, 1e-300)
        self.ways = []
        for _ in range(orderings):
            turn = np.linalg.qr(rng.normal(size=(dim, p)))[0]
            z = (x - self.centre) @ turn
            lo, hi = np.quantile(z, 0.001), np.quantile(z, 0.999)
            self.ways.append((turn, lo, max(hi - lo, 1e-300), rng.uniform(0, 0.5, p)))

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        bits = BITS if x.shape[1] >= DIRECTIONS else min(15, 60 // min(DIRECTIONS, x.shape[1]))
        for turn, lo, width, shift in self.ways:
            u = np.clip((np.clip((x - self.centre) @ turn, lo, lo + width) - lo) / width * 0.5 + shift, 0, 1 - 1e-9)
            out.append(curve((u * (1 << bits)).astype(np.int64), bits))
        return out

    def written(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in bytes, and how far what they say is from them at most."""
        code = np.clip(np.rint((x - self.centre) / self.step), -127, 127)
        err = np.sqrt(((x - self.centre - code * self.step) ** 2).sum(1))
        return code.astype(np.int8), np.nextafter((err * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


def _place(fitted):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                x, c = np.stack(g["vec"]), fitted.value[dim]
                code, err = c.written(x)
                raw = [v.tobytes() for v in code]
                for o, key in enumerate(c.keys(x)):
                    yield pd.DataFrame({"dim": dim, "ordering": o, "key": key, "cid": g["cid"].to_numpy(), "code": raw, "err": err, "asked": g["asked"].to_numpy()})

    return run


def _look(fitted, k: int):
    """In a block of an ordering, what each query's window may hold of its k nearest: q, cid, low and high of its distance."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        q, x = g[g["query"]], g[~g["query"]].sort_values("pos")
        if not len(q) or not len(x):
            return pd.DataFrame({"q": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "low": np.empty(0), "high": np.empty(0)})
        c = fitted.value[int(g["dim"].iloc[0])]
        read = lambda f: np.frombuffer(b"".join(f["code"]), np.int8).reshape(len(f), -1).astype(np.float32)
        rows, asked, pos, ids = read(x), read(q), x["pos"].to_numpy(), x["cid"].to_numpy()
        err, own = x["err"].to_numpy(float), q["err"].to_numpy(float)
        first, last = np.searchsorted(pos, q["pos"] - q["reach"], "left"), np.searchsorted(pos, q["pos"] + q["reach"], "right")
        out = []
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            if a == b:
                continue
            # whole numbers up to 2 * 127: their squares are summed without error
            d = np.sqrt(((rows[a:b] - asked[i]) ** 2).sum(1, dtype=np.float64)) * c.step
            slack = (err[a:b] + own[i]) * (1 + 1e-9) + 1e-12 * d
            high = d + slack
            m = np.flatnonzero(d - slack <= (np.partition(high, k - 1)[k - 1] if len(d) > k else np.inf))
            out.append((np.full(len(m), q["cid"].iloc[i]), ids[a:b][m], (d - slack)[m], high[m]))
        return pd.DataFrame(dict(zip(("q", "cid", "low", "high"), map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({"q": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "low": np.empty(0), "high": np.empty(0)})

    return run


def distance(x: Column, y: Column) -> Column:
    """Euclidean, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def _exact(pairs: DataFrame, cls: DataFrame, k: int) -> DataFrame:
    """q, cid, d: the k nearest of each query among pairs (q, cid), by distances of the vectors themselves."""
    x, y = cls.select(F.col("cid").alias("q"), F.col("vec").alias("x")), cls.select("cid", F.col("vec").alias("y"))
    d = pairs.join(x, "q").join(y, "cid").select("q", "cid", distance(F.col("x"), F.col("y")).alias("d"))
    nth = F.row_number().over(W.partitionBy("q").orderBy("d", "cid"))
    return d.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "cid", "d")


def true_neighbours(cls: DataFrame, picked: pd.DataFrame, k: int) -> DataFrame:
    """q, cid, d: the k nearest of some vectors (cid, dim, vec) by brute force, each itself among them."""

    def near(qid, q, ids, x):
        out = []
        for i in range(len(q)):
            d = np.sqrt(((x - q[i]) ** 2).sum(1))
            m = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            m = m[np.lexsort((ids[m], d[m]))][:k]
            out.append((np.full(len(m), qid[i]), ids[m], d[m]))
        return pd.DataFrame(dict(zip(("q", "cid", "d"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = against_all(cls.select("cid", "dim", "vec"), picked, near, "q long, cid long, d double")
    nth = F.row_number().over(W.partitionBy("q").orderBy("d", "cid"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "cid", "d")


def lay(cls: DataFrame, fitted) -> DataFrame:
    """dim, ordering, pos, cid, code, err, asked: all classes (cid, dim, vec, asked) in every ordering, sorted along its curve."""
    keys = cls.select("cid", "dim", "vec", "asked").mapInPandas(_place(fitted), LAID)
    order = ["dim", "ordering", "key", "cid"]
    laid = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = save(laid.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "hilbert-laid")
    # a row for each ordering's stretch in a partition
    part = laid.groupBy("dim", "ordering", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    part = part.withColumn("base", F.sum("n").over(W.partitionBy("dim", "ordering").orderBy("part")) - F.col("n") - F.col("first")).drop("n", "first")
    part = save(part, "hilbert-parts")
    part = F.broadcast(part) if part.count() <= 1_000_000 else part
    return laid.join(part, ["dim", "ordering", "part"]).select("dim", "ordering", (F.col("nth") + F.col("base")).alias("pos"), "cid", "code", "err", "asked")


def reaches(laid: DataFrame, true: DataFrame, counts: dict[int, int]) -> dict[int, int]:
    """Rows to a side of a window, by dimension: such that RECALL of the true neighbours (q, cid) lie in one of their windows."""
    places = laid.select("dim", "ordering", "pos", "cid")
    ids = save(true.select("q").union(true.select("cid")).distinct().toDF("cid"), "hilbert-pilot")
    places = save(places.join(F.broadcast(ids), "cid"), "hilbert-places")  # of a bounded number of vectors
    both = true.join(places.withColumnRenamed("cid", "q").withColumnRenamed("pos", "at"), "q").join(places, ["dim", "ordering", "cid"])
    least = both.groupBy("dim", "q", "cid").agg(F.min(F.abs(F.col("pos") - F.col("at"))).alias("off"))
    got = {r.dim: r.w for r in least.groupBy("dim").agg(F.percentile("off", F.lit(RECALL)).alias("w")).collect()}
    widest = max(got.values(), default=0)
    return {d: n if n <= SMALL else max(LEAST_WINDOW, int(np.ceil(got.get(d, widest)))) for d, n in counts.items()}


def neighbours(laid: DataFrame, cls: DataFrame, fitted, reach: dict[int, int], k: int) -> DataFrame:
    """q, cid, d: the k nearest found of every asked class, itself among them."""
    wide = F.create_map(*(F.lit(x) for d, w in reach.items() for x in (d, w))) if reach else F.lit(None).cast("map<int,int>")
    size = F.greatest(F.lit(BLOCK), 4 * F.col("reach"))
    placed = laid.withColumn("reach", wide[F.col("dim")].cast("long")).withColumn("size", size)
    rows = placed.withColumn("block", F.floor(F.col("pos") / F.col("size"))).withColumn("query", F.lit(False))
    low, high = F.floor(F.greatest(F.lit(0), F.col("pos") - F.col("reach")) / F.col("size")), F.floor((F.col("pos") + F.col("reach")) / F.col("size"))
    q = placed.where("asked").withColumn("block", F.explode(F.sequence(low, high))).withColumn("query", F.lit(True))
    # rows of blocks without a query stay where they are
    met = q.select("dim", "ordering", "block").distinct()
    keep = ["dim", "ordering", "block", "pos", "reach", "cid", "code", "err", "query"]
    rows = rows.join(met, ["dim", "ordering", "block"], "left_semi")
    found = rows.select(keep).unionByName(q.select(keep)).groupBy("dim", "ordering", "block").applyInPandas(_look(fitted, k), "q long, cid long, low double, high double")
    found = save(found.groupBy("q", "cid").agg(F.max("low").alias("low"), F.min("high").alias("high")), "hilbert-found")
    # what can still be among the k nearest: no further than the k-th at the most
    nth = F.row_number().over(W.partitionBy("q").orderBy("high", "cid"))
    limit = F.max(F.when(F.col("nth") == k, F.col("high"))).over(W.partitionBy("q"))
    pairs = found.withColumn("nth", nth).withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("low") <= F.col("limit"))).select("q", "cid")
    return save(_exact(pairs, cls, k), "hilbert-nearest")


def search(rows: DataFrame, queries, k: int = 10, orderings: int = ORDERINGS) -> DataFrame:
    """query_id, rank, vec_id, score, recall: the k nearest found of each row for which `queries` (a condition) holds.

    rows: vec_id, embedding. Vectors are compared within their dimension; null, empty or zero ones and those with null
    or non-finite components take no part, nor do rows without a vec_id. Equal vectors are neighbours at distance 0; a
    query's own id is never among its neighbours. Ties go to the smaller vec_id, however many there are. Fewer candidates
    than k give all of them. Each of an id's repeated rows is a candidate. `recall` is the
    audit's figure, the same in every row. Other columns are ignored, whatever their names; an empty table gives none.
    """
    members, cls = classes(rows, k + 1)
    counts = {r.dim: r["count"] for r in cls.groupBy("dim").count().toLocalIterator()}
    seen = sample(cls, SAMPLE)
    fits = {}
    for dim in counts:
        own = seen.loc[seen["dim"] == dim, "vec"]
        fits[dim] = Curves(np.stack(own) if len(own) else np.stack([np.zeros(dim), np.ones(dim)]), orderings)
    fitted = cls.sparkSession.sparkContext.broadcast(fits)
    wanted = members.where(queries).select(F.col("vec_id").alias("query_id"), "k1", "k2").join(cls.select("k1", "k2", F.col("cid").alias("q")), ["k1", "k2"]).select("query_id", "q").distinct()
    wanted = save(wanted, "hilbert-queries")
    asked = wanted.select(F.col("q").alias("cid")).distinct().withColumn("asked", F.lit(True))
    marked = cls.join(asked, "cid", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    laid = lay(marked, fitted)

    both = smallest(asked.select("cid"), F.xxhash64("cid"), PILOT + AUDIT).select("cid")
    picked = cls.select("cid", "dim", "vec").join(F.broadcast(both), "cid").toPandas().sort_values("cid", kind="stable")
    turn = np.arange(len(picked)) % 3 == 2
    pilot = picked if len(picked) < 30 else picked[~turn]
    true = save(true_neighbours(cls, picked, k + 1).where("q <> cid"), "hilbert-true") if len(picked) else None
    of = lambda p: true.where(F.col("q").isin(p["cid"].tolist()))
    reach = reaches(laid, of(pilot), counts) if true is not None else {}
    found = neighbours(laid, cls, fitted, reach, k + 1)
    audit = None if true is None else true if len(picked) < 30 else of(picked[turn])
    n = audit.count() if audit is not None else 0
    recall = audit.join(found, ["q", "cid"], "left_semi").count() / n if n else 1.0

    each = found.join(cls.select("cid", "ids"), "cid").select("q", "d", F.explode("ids").alias("vec_id"))
    # what is near to a class is near to each of its queries; the query's own id goes
    lists = save(each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, k + 1).alias("best")), "hilbert-lists")
    out = wanted.join(lists, "q").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", F.col("x.d").alias("score"), F.lit(recall).alias("recall"))


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth embedding; see search()."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).drop("recall")


#: The true neighbours: what the search finds on tables of at most SMALL vectors, where windows hold all.
ORACLE = """
WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM u q JOIN u c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
