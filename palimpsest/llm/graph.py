"""Near-duplicate vectors by a robust-pruned flat graph.

1. Clusters are fitted on a bounded sample; one that is large is split further by the signs of its residuals on random
   directions, as many as its size asks for, so that shards hold about as many vectors at every size of the table. A vector
   goes to the shards of its nearest clusters, and to those beyond the direction that it lies closest to: shards overlap.
2. Each shard builds a graph: of a vertex's nearest candidates those are kept that no kept one is much nearer to (robust
   pruning). Every vertex is looked up by a greedy search from the shard's medoids that, once it stands on the vertex,
   expands all that lies in range. Links are verified by cosines in double precision.
3. The adjacency lists of all shards are united. Through a neighbour in range the search goes on into shards that the
   vertex itself isn't in, until nothing new comes into range.
4. An audit compares with brute force for vectors drawn at random; while it finds less than LEAST_RECALL, the overlap is
   doubled; if that doesn't help, all vectors are compared in blocks, which is exact.

No pair is handed on but those of step 3: a shard gives each vertex the number of its links, counting a pair in the first
shard that both are in, and one link to its component. A shard that stays large, as many near copies of one vector make it,
is cut into parts, and the vertices of different parts are compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import components, save, table
from palimpsest.llm.vectors import against_all, classes, sample, unit, usable

COSINE = 0.95
#: Vertices of a shard about, of a part at most, of a side of a block at most, clusters that a vector belongs to.
SHARD, MOST, BLOCK, OVERLAP = 1_000, 2_000, 8_192, 3
#: Vectors that clusters are fitted on, clusters before they are split, overlap at most.
SAMPLE, CLUSTERS, WIDEST = 20_000, 4_096, 24
#: Candidates before pruning, neighbours after it, how much nearer another must be to replace an edge, medoids.
CANDIDATES, DEGREE, ALPHA, STARTS = 32, 12, 1.2, 8
#: The search expands vertices this much below the range too.
MARGIN = 0.03
#: Vectors of the audit, links that it must compare to say anything, recall below which it isn't content.
AUDIT, EVIDENCE, LEAST_RECALL = 1_000, 30, 0.98
#: Bits of a split at most.
MOST_BITS = 40

SHARDS = "shard long, cid long, n long, shards array<long>, vec array<double>"
FOUND = "cid long, links long, root long, shards array<long>, near array<struct<cid: long, shards: array<long>>>, close array<long>"


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        full = np.abs(s).sum(1) > 0
        c[full] = unit(s[full])
    return c


class Cells:
    """Clusters of one dimension, and how many bits each is split by."""

    def __init__(self, x: np.ndarray | None, total: int, overlap: int):
        self.overlap, self.dim = overlap, 0 if x is None else x.shape[1]
        k = 1 if x is None else max(1, min(CLUSTERS, len(x) // 4, math.ceil(total * overlap / SHARD)))
        self.centres = np.zeros((1, self.dim)) if k == 1 else clusters(x, k)
        self.bits = np.zeros(len(self.centres), int)
        if k > 1:
            each = np.bincount((np.argsort(-(x @ self.centres.T), axis=1)[:, : min(overlap, k)]).ravel(), minlength=k) * (total / len(x))
            self.bits = np.clip(np.ceil(np.log2(np.maximum(each, 1) / (2 * SHARD))), 0, MOST_BITS).astype(int)
        self.planes = np.random.default_rng(13).normal(size=(self.dim, int(self.bits.max())))

    def of(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cluster and code of every cell that unit vectors go to."""
        if len(self.centres) == 1:
            return np.arange(len(u)), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        m = min(self.overlap, len(self.centres))
        near = np.argsort(-(u @ self.centres.T), axis=1, kind="stable")[:, :m]
        rows, cluster = np.repeat(np.arange(len(u)), m), near.ravel()
        code, out = np.zeros(len(rows), np.int64), []
        for b in np.unique(self.bits[cluster]):
            if b:
                own = np.flatnonzero(self.bits[cluster] == b)
                side = (u[rows[own]] - self.centres[cluster[own]]) @ self.planes[:, :b]
                code[own] = (side > 0) @ (1 << np.arange(b, dtype=np.int64)) + (1 << b)
                beyond = code[own] ^ (1 << np.abs(side).argmin(1))
                out.append((rows[own], cluster[own], beyond))
        out.append((rows, cluster, code))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _assign(cells):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, g in f.groupby("dim"):
                u = unit(np.stack(g["vec"]))
                rows, cluster, code = cells.value[d].of(u)
                # a number for each cell of each dimension: collisions only make a shard hold two cells
                shard = np.array([hash((int(d), int(c), int(b))) for c, b in zip(cluster, code, strict=True)], np.int64)
                order = np.lexsort((shard, rows))
                rows, shard = rows[order], shard[order]
                own = np.split(shard, np.flatnonzero(np.diff(rows)) + 1)
                own = [np.unique(x) for x in own]
                k = np.array([len(x) for x in own])
                rows = np.repeat(np.arange(len(g)), k)
                vec = g["vec"].to_numpy()
                yield pd.DataFrame({"shard": np.concatenate(own), "cid": g["cid"].to_numpy()[rows], "n": g["n"].to_numpy()[rows], "shards": [own[i] for i in rows], "vec": [vec[i] for i in rows]})

    return run


def prune(sim: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned neighbours of every vertex from the similarities of a shard; -1 where there are fewer than `degree`."""
    n = len(sim)
    m = min(candidates, n - 1)
    if m < 1:
        return np.full((n, 1), -1)
    s = sim.copy()
    np.fill_diagonal(s, -np.inf)
    cand = np.argpartition(-s, m - 1, axis=1)[:, :m]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(s, cand, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, cand, 1)))
    alive, rows = np.ones(cand.shape, bool), np.arange(n)
    out = np.full((n, min(degree, m)), -1)
    for j in range(out.shape[1]):
        has, first = alive.any(1), alive.argmax(1)
        if not has.any():
            break
        c = np.where(has, cand[rows, first], -1)
        out[:, j] = c
        alive[rows, first] = False
        alive &= alpha * np.sqrt(np.maximum(0, 2 - 2 * sim[c[:, None], cand])) > far
    return out


def search(sim: np.ndarray, near: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Which vertices each vertex finds in range: greedy from the medoids until it stands on itself, then outwards through
    all in range. All vertices are looked up side by side. One that the greedy search can't reach is compared with all."""
    n = len(sim)
    medoid = np.argsort(-sim.sum(1), kind="stable")[: max(1, STARTS // 2)]
    starts = np.unique(np.concatenate([medoid, np.linspace(0, n - 1, min(n, STARTS)).astype(int)]))
    seen, open_ = np.zeros((n, n), bool), np.full((n, n), -np.inf)
    seen[:, starts], open_[:, starts] = True, sim[:, starts]
    todo = np.arange(n)
    for _ in range(n):
        todo = todo[~seen[todo, todo]]
        if not len(todo):
            break
        best = open_[todo].argmax(1)
        stuck = open_[todo, best] == -np.inf
        seen[todo[stuck]] = True
        todo, best = todo[~stuck], best[~stuck]
        open_[todo, best] = -np.inf
        r, c = np.repeat(todo, near.shape[1]), near[best].ravel()
        r, c = r[c >= 0], c[c >= 0]
        new = ~seen[r, c]
        r, c = r[new], c[new]
        seen[r, c], open_[r, c] = True, sim[r, c]
    wide = sim >= cosine - MARGIN
    r, c = np.nonzero(seen & wide)
    while len(r):
        a, b = np.repeat(r, near.shape[1]), near[c].ravel()
        a, b = a[b >= 0], b[b >= 0]
        new = ~seen[a, b]
        code = np.unique(a[new] * n + b[new])
        a, b = code // n, code % n
        seen[a, b] = True
        on = wide[a, b]
        r, c = a[on], b[on]
    hit = seen & (sim >= cosine)
    np.fill_diagonal(hit, False)
    return hit | hit.T


def _smaller(shards: pd.Series, shard: int, fill: int) -> np.ndarray:
    """The shards of each row that come before this one, padded by a number that is none."""
    own = [np.asarray(x, np.int64) for x in shards]
    own = [x[x < shard] for x in own]
    out = np.full((len(own), max(1, max(map(len, own), default=1))), fill, np.int64)
    for i, x in enumerate(own):
        out[i, : len(x)] = x
    return out


def _first(r: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs are in no shard together that comes before this one, and so are counted here."""
    out = np.ones(len(r), bool)
    for i in range(0, len(r), 200_000):
        out[i : i + 200_000] = ~(a[r[i : i + 200_000]][:, :, None] == b[c[i : i + 200_000]][:, None, :]).any((1, 2))
    return out


def _roots(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest vertex of each one's component."""
    label = np.arange(n)
    while len(r):
        old = label.copy()
        np.minimum.at(label, r, old[c])
        np.minimum.at(label, c, old[r])
        label = label[label]
        if (label == old).all():
            break
    return label


def _shard(g: pd.DataFrame) -> pd.DataFrame:
    """Builds and searches the graph of a part."""
    g = g.sort_values("cid")
    ids, n, shard = g["cid"].to_numpy(), g["n"].to_numpy(), int(g["shard"].iloc[0])
    u = unit(np.stack(g["vec"]))
    sim = u @ u.T
    near = prune(sim)
    r, c = np.nonzero(search(sim, near))
    a, b = _smaller(g["shards"], shard, -1), _smaller(g["shards"], shard, -2)
    counted = _first(r, c, a, b)
    links = np.bincount(r[counted], n[c[counted]], len(g)).astype(np.int64)
    shards = [np.asarray(x, np.int64) for x in g["shards"]]
    lists = [[{"cid": ids[j], "shards": shards[j]} for j in x if j >= 0] for x in near]
    close = [ids[[j for j in x if j >= 0 and sim[i, j] >= COSINE - MARGIN]] for i, x in enumerate(near)]
    # lists are handed on where the search can go on through them
    wanted = set(np.concatenate([*close, np.empty(0, np.int64)]).tolist())
    return pd.DataFrame({"cid": ids, "links": links, "root": ids[_roots(len(g), r, c)], "shards": shards, "near": [x if i in wanted or len(o) else [] for i, x, o in zip(ids, lists, close, strict=True)], "close": close})


def _block(g: pd.DataFrame) -> pd.DataFrame:
    """Vertices of different parts of a shard, compared: links of both sides, and one link of each to its component."""
    same = int(g["i"].iloc[0]) == int(g["j"].iloc[0])
    x = g[g["first"]].sort_values("cid")
    y = x if same else g[~g["first"]].sort_values("cid")
    if not len(x) or not len(y):
        return pd.DataFrame({"cid": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
    shard = int(g["shard"].iloc[0])
    v, px, py, nx, ny = unit(np.stack(y["vec"])), x["own"].to_numpy(), y["own"].to_numpy(), x["n"].to_numpy(), y["n"].to_numpy()
    a, b = _smaller(x["shards"], shard, -1), _smaller(y["shards"], shard, -2)
    ids = x["cid"].to_numpy() if same else np.concatenate([x["cid"].to_numpy(), y["cid"].to_numpy()])
    shift, links, label = 0 if same else len(x), np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(0, len(x), 256):
        sim = unit(np.stack(x["vec"].iloc[i : i + 256])) @ v.T
        r, c = np.nonzero((sim >= COSINE) & (px[i : i + 256][:, None] != py[None, :]))
        r = r + i
        counted = _first(r, c, a, b)
        links += np.bincount(r[counted], ny[c[counted]], len(ids)).astype(np.int64)
        if not same:
            links += np.bincount(c[counted] + shift, nx[r[counted]], len(ids)).astype(np.int64)
        label = _roots(len(ids), label[r], label[c + shift])[label]
    some = (links > 0) | (label != np.arange(len(ids)))
    return pd.DataFrame({"cid": ids[some], "links": links[some], "root": ids[label[some]]})


def links(cls: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """cid, links (the vectors of other classes that are linked) of classes (cid, dim, vec, n), and links (a, b) that span
    their components. overlap 0: everything is one shard, compared in blocks."""
    spark = cls.sparkSession
    seen = sample(cls, SAMPLE) if overlap else None
    counts = {r.dim: r["count"] for r in cls.groupBy("dim").count().toLocalIterator()}
    cells = {d: Cells(unit(np.stack(seen.loc[seen["dim"] == d, "vec"])) if seen is not None and (seen["dim"] == d).any() else None, t, max(1, overlap)) for d, t in counts.items()}
    put = save(cls.select("cid", "dim", "vec", "n").mapInPandas(_assign(spark.sparkContext.broadcast(cells)), SHARDS), "graph-shards")
    large = put.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > MOST)
    large = save(large.select("shard", F.ceil(F.col("size") / MOST).cast("int").alias("parts"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "graph-large")
    few = F.broadcast(large) if large.count() <= 100_000 else large
    parted = put.join(few, "shard", "left").withColumn("own", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int"))
    found = save(parted.select("shard", "own", "cid", "n", "shards", "vec").groupBy("shard", "own").applyInPandas(_shard, FOUND), "graph-found")
    out, spans = found.select("cid", "links"), found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))

    if not large.isEmpty():
        blocked = parted.where("parts > 1").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int"))
        pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        each = blocked.withColumn("other", pair).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("first", F.col("block") == F.col("i"))
        more = save(each.select("shard", "i", "j", "first", "own", "cid", "n", "shards", "vec").groupBy("shard", "i", "j").applyInPandas(_block, "cid long, links long, root long"), "graph-blocks")
        out, spans = out.unionByName(more.select("cid", "links")), spans.unionByName(more.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))

    # united lists: through neighbours in range into shards that the vertex isn't in itself
    united = found.where(F.size("near") > 0).groupBy("cid").agg(F.flatten(F.collect_list("near")).alias("near"), F.first("shards").alias("shards"))
    united = save(united, "graph-united")
    at = save(found.where(F.size("close") > 0).select("cid", "shards", F.explode("close").alias("at")).groupBy("cid", "at").agg(F.first("shards").alias("shards")), "graph-close")
    vecs, known, crossing = cls.select("cid", "vec", "n"), None, None
    while not at.isEmpty():
        ahead = at.join(united.select(F.col("cid").alias("at"), "near"), "at").select("cid", "shards", F.explode("near").alias("v"))
        ahead = ahead.where(~F.arrays_overlap("shards", "v.shards")).select("cid", "shards", F.col("v.cid").alias("other"))
        ahead = ahead.groupBy("cid", "other").agg(F.first("shards").alias("shards"))
        ahead = ahead if known is None else ahead.join(known, ["cid", "other"], "left_anti")
        met = ahead.join(vecs.select("cid", F.col("vec").alias("x")), "cid").join(vecs.select(F.col("cid").alias("other"), F.col("vec").alias("y")), "other")
        met = save(met.select("cid", "other", "shards", cosine(F.col("x"), F.col("y")).alias("cos")), "graph-crossing")
        known = met.select("cid", "other") if known is None else known.unionByName(met.select("cid", "other"))
        # what one of both finds counts for both
        hits = met.where(F.col("cos") >= COSINE).select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"))
        crossing = hits if crossing is None else crossing.unionByName(hits)
        at = met.where(F.col("cos") >= COSINE - MARGIN).select("cid", F.col("other").alias("at"), "shards")
    if crossing is not None:
        crossing = save(crossing.distinct(), "graph-across")
        sides = crossing.unionAll(crossing.select("b", "a")).toDF("cid", "b").join(vecs.select(F.col("cid").alias("b"), "n"), "b")
        out, spans = out.unionByName(sides.select("cid", F.col("n").alias("links"))), spans.unionByName(crossing)
    return save(out.groupBy("cid").agg(F.sum("links").alias("links")), "graph-links"), spans


def cosine(x, y):
    """The cosine of two array columns, in double precision."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    top = lambda a: F.array_max(F.transform(a, F.abs))
    x, y = F.transform(x, lambda i: i / top(x)), F.transform(y, lambda i: i / top(y))
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def audit(cls: DataFrame, found: DataFrame, most: int = AUDIT) -> float | None:
    """The share of brute force's links of `most` vectors drawn at random that were found; None if these have too few."""
    picked = sample(cls, most, "k2")
    if not len(picked):
        return None

    def count(qid, q, ids, n, x):
        hit = unit(q) @ unit(x).T >= COSINE
        hit &= qid[:, None] != ids[None, :]
        return pd.DataFrame({"cid": qid, "links": hit @ n})

    true = against_all(cls.select("cid", "dim", "vec", "n"), picked, count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("true"))
    n, got = true.join(found, "cid", "left").agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum("links"), F.lit(0))).first()
    return got / n if n >= EVIDENCE else None


def near_duplicates(rows: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for every row of rows (vec_id, embedding).

    Vectors are compared within their dimension. Null, empty or zero vectors and those with null or non-finite
    components link with nothing; so does a row whose vec_id is null, and its component is null. Equal vectors are
    linked with each other; repeated rows are rows. `recall` is the audit's figure, the same in every row; null where too
    few links were met to say. Ties don't matter: every link counts. Other columns are ignored, whatever their names; an
    empty table gives none.
    """
    members, cls = classes(rows, 1)
    while True:
        found, spans = links(cls, overlap)
        recall = audit(cls, found)
        if recall is None or recall >= LEAST_RECALL or not overlap:
            break
        overlap = overlap * 2 if overlap * 2 <= WIDEST else 0
    labels = components(spans)
    named = cls.select("k1", "k2", "cid", "n").join(found, "cid", "left").join(labels, F.col("cid") == F.col("node"), "left")
    named = save(named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "cid").alias("component_id")), "graph-named")
    out = members.join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("vec_id").isNull() | ~usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = out.unionAll(rest)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def op8_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, len(v) AS dim FROM v WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec, other) AS (SELECT a, b FROM e UNION SELECT r.vec, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT vec, min(other) AS other FROM r GROUP BY vec),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(m.other, v.vec_id)) AS component_id, coalesce(m.other, v.vec_id) >= v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.vec = v.vec_id
"""
