"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Every text becomes the set of hashes of its distinct shingles; equal sets are one class from then on.
2. A class keeps its k smallest hashes. Inverted lists hold, for each run of RUN neighbouring retained hashes, the
   classes that have it. Two sets with similarity t agree on each hash of their common sketch with probability t, so
   they share many runs (of sets that fit into a sketch: always one at least), while texts that merely share words or a
   passage share few.
3. A class is looked up under its rarest runs alone, all but the m-1 that most classes share: two classes that share m
   runs still meet (the prefix principle), and lists of common passages stay unused.
4. Pairs from the lists pass a size test, then the union-sketch estimate, then the exact test on whole sets.
5. Only what decides components is tested: each class first against the best-connected class that it meets most often,
   then against a few random leaders of its lists that are still in other components; at last all pairs of different
   components that meet in a list, so no list is cut short. Classes that meet a component again and again are compared
   with it in blocks, which hand on links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import WordHashes, column_bytes, components, drop, ease_driver, lists, mix, save, shingles, small, spread, table, unused

#: Sketch size, length of runs, runs that a pair is sure enough to share, slack of the estimate (five deviations).
SKETCH, RUN, SHARED, SLACK = 64, 3, 6, 0.27
#: Turns of which the last tests all open pairs, and leaders that a class is tested against in each one before.
TURNS, CHOICES = 3, 4
#: Classes to a side of a block.
BLOCK = 512
#: Ids up to which the filter for texts to verify is broadcast; beyond, a shuffled semi-join.
BROADCAST_IDS = 1_000_000

SKETCHES = "doc_id long, n long, f1 long, f2 long, sketch array<long>"


def _sketch(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in small(batches):
            sets = [shingles(hashes.of((t or b"").lower().split()), words) for t in column_bytes(b, "text")]
            prints = np.array([[xxhash.xxh3_64_intdigest(s, seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists([s[:size].astype(np.int64) for s in sets], pa.int64())],
                ["doc_id", "n", "f1", "f2", "sketch"],
            )

    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in small(batches):
            sets = [shingles(hashes.of((t or b"").lower().split()), words).astype(np.int64) for t in column_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), lists(sets, pa.int64())], ["id", "set"])

    return run


def _runs(run: int):
    """rep, n, k, key for each run of a sketch, k being their number; for the smallest sets, of which pairs may share but two neighbours, also for runs of two."""

    def keys(s: np.ndarray) -> np.ndarray:
        s = s.astype(np.uint64)
        out = [shingles(s, run)] if len(s) >= run else []
        if 2 <= len(s) <= 5:
            out.append(mix(shingles(s, 2)) >> np.uint64(1))
        return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            ends, flat = col.offsets.to_numpy(), col.values.to_numpy()
            each = [keys(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            k = np.array([len(x) for x in each], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(np.repeat(b.column(1).to_numpy(), k)), pa.array(np.repeat(k, k)), pa.array(np.concatenate([*each, np.empty(0, np.int64)]))], ["rep", "n", "k", "key"])

    return rows


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows; classes (f1, f2, rep, n); verified links (a, b) between representatives that decide components.

    Rows of the same doc_id count as one document: their classes are linked. Rows without words belong to no class.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = save(docs.mapInArrow(_sketch(words, SKETCH), SKETCHES), "minhash-sketches")
    classes = save(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "minhash-classes")

    own = rows.where("n > 0").join(classes.drop("n"), ["f1", "f2"]).select("doc_id", "n", "rep", "sketch")
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same = own.join(twice.select("doc_id", "a"), "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    sketches = save(own.where("doc_id = rep").select("rep", "n", "sketch").dropDuplicates(["rep", "n"]), "minhash-representatives")

    runs = save(sketches.select("rep", "n", "sketch").mapInArrow(_runs(RUN), "rep long, n long, k long, key long"), "minhash-runs")
    often = runs.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # for whole sets of n shingles a pair shares 0.4 n - 2 runs at least
    sure = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(F.col("n") * 0.4 - 2).cast("int")))
    mine = runs.join(often, "key").groupBy("rep", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("by_df"))
    mine = mine.withColumn("use", (F.col("k") - sure + 1 - (F.col("k") - F.size("by_df"))).cast("int")).where("use > 0")
    post = mine.select("rep", "n", F.size("by_df").alias("met"), F.explode(F.slice("by_df", F.lit(1), F.col("use"))).alias("x")).select("x.key", "rep", "n", "met")
    post = save(post, "minhash-lists")
    drop(runs)

    tested = same.select("a", "b", F.lit(True).alias("linked"))
    best = F.max(F.struct("met", (-F.col("rep")).alias("r"), "n"))
    leaders = post.groupBy("key").agg(best.alias("lead")).select("key", (-F.col("lead.r")).alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.met").alias("leader_met"))
    meet = post.join(leaders, "key").where("rep <> leader").groupBy("rep", "n", "leader", "leader_n", "leader_met").count()
    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    first = meet.where(near("n", "leader_n")).groupBy("rep").agg(F.max(F.struct("count", "leader_met", (-F.col("leader")).alias("l"))).alias("m"))
    pairs = first.select(F.least("rep", -F.col("m.l")).alias("a"), F.greatest("rep", -F.col("m.l")).alias("b")).distinct()
    tested = save(tested.unionByName(_verify(pairs, sketches, docs, words, percent)), "minhash-tested")

    for turn in range(1, TURNS + 1):
        ease_driver(docs.sparkSession)  # each turn plans some twenty jobs
        labels = components(tested.where("linked").select("a", "b"))
        every = save(post.join(labels, post["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label")), "minhash-labels")
        mixed = save(every.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "minhash-mixed")
        p = save(every.join(mixed, "key"), "minhash-open")
        drop(every, mixed)
        if p.isEmpty():
            break
        if turn < TURNS:
            pairs = _some(p, turn, near)
        else:
            pairs, blocks = _every(p, labels, sketches, near)
            blocks = save(blocks, "minhash-meetings")
            sets = _sets(docs, blocks.select(F.col("rep").alias("id")), words)
            met = blocks.join(sets.select(F.col("id").alias("rep"), F.size("set").cast("long").alias("n"), "set"), ["rep", "n"])
            more = met.groupBy("main", "i", "j").applyInPandas(_compare(percent), "a long, b long").distinct().withColumn("linked", F.lit(True))
            tested = save(tested.unionByName(more), "minhash-tested")
        pairs = save(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        before, tested = tested, save(tested.unionByName(_verify(pairs, sketches, docs, words, percent)), "minhash-tested")
        drop(before, pairs, p)
    drop(post)
    ease_driver(docs.sparkSession)
    return rows, classes, tested.where("linked").select("a", "b")


def _ends(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _some(p: DataFrame, turn: int, near) -> DataFrame:
    """For each class, leaders of its lists that are in other components, those of most of its lists first."""
    chance = F.xxhash64("key", "rep", F.lit(turn))
    lead = p.groupBy("key").agg(F.max(F.struct(chance.alias("h"), "rep", "n", "label")).alias("l")).select("key", F.col("l.rep").alias("leader"), F.col("l.n").alias("m"), F.col("l.label").alias("other"))
    star = p.join(save(lead, "minhash-leaders"), "key").where((F.col("label") != F.col("other")) & near("n", "m"))
    star = star.groupBy("rep", "leader").agg((-F.count("*")).alias("c")).withColumn("h", F.xxhash64("rep", "leader"))
    few = star.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("c", "h", "leader"))), 1, CHOICES).alias("few"))
    return few.select("rep", F.explode("few.leader").alias("leader")).select(*_ends("rep", "leader"))


def _every(p: DataFrame, labels: DataFrame, sketches: DataFrame, near) -> tuple[DataFrame, DataFrame]:
    """All pairs of different components that meet in a list: pairs to verify, and blocks to compare.

    A class outside its list's main component is compared along its lists where these are shorter than the component.
    Otherwise it would give the same pairs again and again, and goes to blocks: with the component's members and the
    others that go there. Pairs of two such classes meet in the blocks, all others along the lists.
    """
    size = p.groupBy("key", "label").agg(F.count("*").alias("here"))
    main = size.groupBy("key").agg(F.max(F.struct("here", "label")).alias("m"), F.sum("here").alias("members")).select("key", F.col("m.label").alias("main"), "members")
    q = save(p.join(save(main, "minhash-main"), "key"), "minhash-outside")
    out = q.where("label <> main")
    full = labels.groupBy("label").agg(F.count("*").alias("size")).withColumnRenamed("label", "main")
    cost = out.groupBy("rep", "n", "label", "main").agg(F.sum("members").alias("along")).join(full, "main", "left").na.fill(1, ["size"])
    cost = save(cost.withColumn("by_list", F.col("along") <= F.col("size")), "minhash-cost")
    some = out.join(cost.where("by_list").select("rep", "main"), ["rep", "main"]).select("key", "rep", "n", "label")
    x, y = some.alias("x"), q.alias("y")
    cross = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & near("x.n", "y.n")
    pairs = y.join(x, cross).select(*_ends("x.rep", "y.rep"))

    guests = cost.where("not by_list").select("main", "rep", "label", "n")
    mains = save(guests.groupBy("main").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("xs"), F.count("*").alias("guests")), "minhash-guests")
    known = labels.select(F.col("label").alias("main"), F.col("node").alias("rep"))
    alone = mains.select("main", F.col("main").alias("rep")).join(known, ["main", "rep"], "left_anti")
    home = known.unionAll(alone).join(mains.select("main"), "main", "left_semi").join(sketches.select("rep", "n"), "rep").select("main", "rep", F.col("main").alias("label"), "n")
    all_ = save(home.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))), "minhash-universe")
    ys = all_.groupBy("main").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("ys"))
    mains = save(mains.join(ys, "main").select("main", "xs", "ys"), "minhash-blocks")
    all_ = all_.join(mains, "main").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("xs")).cast("int")).withColumn("j", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ys")).cast("int"))
    role = lambda r: F.lit(r).alias("asks")
    asks = all_.where("guest").select("main", "i", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("j"), "rep", "label", "n", role(True))
    told = all_.select("main", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("i"), "j", "rep", "label", "n", role(False))
    return pairs, asks.unionByName(told)


def _compare(percent: int):
    """In a block, for each class that asks, one linked class of each other component: exact, on whole sets."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["asks"]], g[~g["asks"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        flat = [np.concatenate([np.asarray(v, np.int64) for v in s["set"]]) for s in (x, y)]
        rows = [np.repeat(np.arange(len(s)), s["set"].map(len)) for s in (x, y)]
        both = np.intersect1d(flat[0], flat[1])
        at = [np.searchsorted(both, f) for f in flat]
        hit = [both[np.minimum(a, len(both) - 1)] == f if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat, strict=True)]
        common = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, len(both), 4096):
            sides = []
            for s, r, a, h in zip((x, y), rows, at, hit, strict=True):
                m = np.zeros((len(s), min(4096, len(both) - low)), np.float32)
                here = h & (a >= low) & (a < low + 4096)
                m[r[here], a[here] - low] = 1
                sides.append(m)
            common += sides[0] @ sides[1].T
        n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        ok = (100 * common >= percent * (n + m - common)) & (x["label"].to_numpy()[:, None] != y["label"].to_numpy()[None, :])
        i, j = np.nonzero(ok)
        f = pd.DataFrame({"x": x["rep"].to_numpy()[i], "y": y["rep"].to_numpy()[j], "label": y["label"].to_numpy()[j]}).groupby(["x", "label"], as_index=False)["y"].min()
        return pd.DataFrame({"a": np.minimum(f["x"], f["y"]), "b": np.maximum(f["x"], f["y"])})

    return run


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, set of the documents named: their whole shingle sets, from their texts."""
    ids = save(ids.distinct(), "minhash-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = docs.select(F.col("doc_id").alias("id"), "text").join(few, "id", "left_semi").mapInArrow(_full(words), "id long, set array<long>")
    return sets.where(F.size("set") > 0)


def _verify(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs (a, b) with `linked`, after the union-sketch estimate and the exact test on whole sets."""
    a, b = sketches.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), sketches.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    p = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    estimate = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b"))) / F.size(union)
    whole = F.least("n_a", "n_b") <= SKETCH // 2  # of small sets the estimate says too little to reject
    p = save(p.withColumn("may", whole | (estimate >= percent / 100 - SLACK)).select("a", "b", "n_a", "n_b", "may"), "minhash-estimates")
    q = p.where("may")
    sets = _sets(docs, q.select(F.col("a").alias("id")).unionAll(q.select(F.col("b").alias("id"))), words)
    sides = [sets.select(F.col("id").alias(c), F.size("set").cast("long").alias(f"n_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab"]
    both = F.size(F.array_intersect("set_a", "set_b"))
    done = q.join(sides[0], ["a", "n_a"]).join(sides[1], ["b", "n_b"]).groupBy("a", "b").agg(F.max(both * 100 >= percent * (F.col("n_a") + F.col("n_b") - both)).alias("linked"))
    return done.unionByName(p.where("not may").groupBy("a", "b").agg(F.lit(False).alias("linked")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Words are lower-cased (A-Z) and split at ASCII white space. Documents are linked with
    100 * intersection >= percent * union of their shingle sets. A null, empty or blank text has no shingles and is
    linked with nothing; fewer words than a shingle make one shingle; a very long text is one set. A null doc_id is a document like others, except
    that null ids are never linked and have a null component. An empty table gives none.
    """
    rows, classes, links = link(docs.where("doc_id is not null"), words, percent)
    labels = components(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("f1", "f2", F.coalesce("label", "rep").alias("component_id"))
    named = save(named, "minhash-named")
    out = rows.where("n > 0").join(named, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    nulls = spread(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(_sketch(words, 1), SKETCHES)
    out = out.unionAll(nulls.select("doc_id", "n", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each group, with all their columns whatever their names.

    Rows that share an id, or have none, are documents of their own, told apart by their texts: those that aren't near
    copies of anything all stay. Of rows that agree in id and text one stays. Null, empty and blank texts are linked with
    nothing, so each such id keeps one row; very long texts are compared whole. Of a group the smallest id stays, or where
    ids repeat the smallest hash. An empty table gives none.
    """
    key, mark = unused("key", docs), unused("again", docs)
    id_ = F.col("doc_id").cast("long")
    often = save(docs.groupBy(id_.alias("o_id")).count().where("count > 1 or o_id is null").select("o_id"), "minhash-repeated")
    repeated = not often.isEmpty()
    keyed = docs.withColumn(mark, F.lit(False)).withColumn(key, id_)
    if repeated:
        few = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
        same = few.select(F.col("o_id").alias(unused("o_id", keyed)))
        o_id = same.columns[0]
        # a marked row's key is a hash of id and text: no text is compared by anything but its whole set later on
        keyed = docs.withColumn(key, id_).join(same.withColumn(mark, F.lit(True)), F.col(key).eqNullSafe(F.col(o_id)), "left").drop(o_id).withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))
        keyed = keyed.withColumn(key, F.when(F.col(mark), F.xxhash64(F.col(key), F.col("text").cast("string"))).otherwise(F.col(key)))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent).select("doc_id", "kept")
    gone = save(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "minhash-gone")
    gone = gone.select(F.col("gone").alias(unused("gone", keyed)))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = keyed.join(few, F.col(key) == F.col(gone.columns[0]), "left_anti")
    if repeated:
        kept = kept.where(~F.col(mark)).unionAll(kept.where(F.col(mark)).dropDuplicates([key]))
    return kept.drop(key, mark)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by two-word shingles; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, other) AS (SELECT a, b FROM e UNION SELECT r.doc, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc, min(other) AS other FROM r GROUP BY doc)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.other, d.doc_id)) AS component_id, coalesce(m.other, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc = d.doc_id
"""
