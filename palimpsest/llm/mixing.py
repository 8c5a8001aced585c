"""Mixing sources to target weights by Pareto order sampling.

A source's target is met by unequal inclusion: a document of measure m (the bits of its size) is expected c * m times,
`copies` at most, with c such that the expected words of the source are its target. The whole part of that expectation is
certain copies; the fraction p is the inclusion probability of one more. Documents are ranked by odds(u) / odds(p) with u
a hash of the id, and the smallest ranks are taken as long as they fit into the words that certain copies leave: a sample
of fixed size, the same in every run. Of all documents left out, the one that comes nearest to the remaining gap fills it.

What decides is a handful of numbers for each source: c, the rank of the last document taken, and the one that fills the
gap. They are found from sums by level, by bucket and by bucket within the one that meets the target; only the documents
of one bucket in 2**20 are ordered. Every row then decides for itself, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import WORDS, quoted, save, spread, table

#: Words to mix as a share of all words, weights dealt to the sources in order, and most copies of a document.
SHARE, WEIGHTS, COPIES = 1.5, (3, 1, 2), 2
#: Buckets of ranks at each of two levels.
BUCKETS = 1024
#: Sources up to which their decisions are broadcast (some 200 bytes each); beyond, a shuffled join.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """source, source_size, target: budgets by weight, none above `copies` times its source.

    The level at which budgets stop growing is found in one pass over the sources in the order in which they fill up.
    One row per source takes part, never one per document.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size").cast("double") * copies).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order, every = W.orderBy("fills_at", F.col("source").asc_nulls_last()), W.partitionBy()
    s = s.withColumn("full", F.sum("cap").over(order) - F.col("cap")).withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("full")) / F.col("open"))
    # of sources that fill up at the same level the first says it, whose own is the highest
    level = -F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", (-F.col("level")).alias("low")))).over(every)["low"]
    return s.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def random_unit(col: Column) -> Column:
    """A number in (0, 1) from the md5 of an id: the same on every engine and run."""
    h = F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(1 << 48))


def measure(size: Column) -> Column:
    """What inclusion is proportional to: the bits of a size, so that a document of twice the words counts one more."""
    return F.length(F.bin(size)).cast("long")


def _sized(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with an id, a source, a size, and a hash of the text under the names given."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.withColumns({names["doc_id"]: F.col("doc_id").cast("long"), names["source"]: F.col("source").cast("string"), names["size"]: size, names["tie"]: F.xxhash64(F.col("text").cast("string"))})


def _ranked(rows: DataFrame, per: DataFrame, copies: int, few: bool) -> DataFrame:
    """rows (doc_id, source, size, tie, ...) joined with their source's line of `per`, and whole, p and key, the place in its order."""
    per = F.broadcast(per) if few else per
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    expected = F.least(F.lit(float(copies)), F.col("c") * measure(F.col("size")).cast("double"))
    rows = rows.withColumn("expected", F.when(F.col("source_size") > 0, expected).otherwise(0.0)).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    u = random_unit(F.col("doc_id"))
    q = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    return rows.withColumn("q", q).withColumn("key", F.when(F.col("q").isNotNull(), F.struct("q", "doc_id", "size", "tie"))).drop("expected")


def cuts(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> tuple[DataFrame, bool]:
    """What decides in each source: s_source, source_size, target, c, cut (the last rank taken), cut_in of cut_n equal rows
    that are in, best (fills the gap, one of best_n equal rows); and whether there are few sources."""
    per = targets(sizes, share, weights, copies)
    level = sizes.groupBy("source", measure(F.col("size")).alias("m")).agg(F.sum("size").alias("words"))
    level = level.join(per.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    down = W.partitionBy("source").orderBy("m")
    rest = F.col("target") - F.lit(float(copies)) * (F.sum("words").over(W.partitionBy("source")) - F.sum("words").over(down)).cast("double")
    weighed = F.sum(F.col("m") * F.col("words")).over(down).cast("double")
    level = level.withColumn("c", F.when(weighed > 0, rest / weighed))
    # the most levels that can go without reaching the largest number of copies; where none can, all reach it
    fits = (F.col("words") > 0) & (F.col("c") * F.col("m").cast("double") <= copies)
    level = level.withColumn("c", F.coalesce(F.max(F.when(fits, F.struct("m", "c"))).over(W.partitionBy("source"))["c"], F.lit(float(copies))))
    whole = F.sum(F.floor(F.least(F.lit(float(copies)), F.col("c") * F.col("m").cast("double"))) * F.col("words"))
    per = level.groupBy(F.col("source").alias("s_source")).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("c").alias("c"), whole.alias("certain"))
    per = save(per.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain").cast("double"))).drop("certain"), "mixing-levels")
    few = per.count() <= BROADCAST_SOURCES
    on = lambda name: F.col("source").eqNullSafe(F.col(name))
    near = lambda df: F.broadcast(df) if few else df

    rows = _ranked(sizes, per, copies, few).where("p > 0")
    place = F.least(F.floor(F.col("q") / (F.col("q") + 1) * (BUCKETS * BUCKETS)), F.lit(BUCKETS * BUCKETS - 1))
    rows = save(rows.select("source", "rest", "size", "key", place.alias("fine"), F.floor(place / BUCKETS).alias("coarse")), "mixing-ranks")

    def meeting(df: DataFrame, bucket: str, start: Column) -> DataFrame:
        """b_source, b_bucket, before: the bucket of each source in which its words pass the rest, and the words before it."""
        sums = df.groupBy("source", "rest", "before", bucket).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", start + F.sum("words").over(W.partitionBy("source").orderBy(bucket)))
        last = F.max(F.when(F.col("upto") - F.col("words") <= F.col("rest"), F.struct(F.col(bucket), (F.col("upto") - F.col("words")).alias("before"))))
        return sums.groupBy("source").agg(last.alias("b")).select(F.col("source").alias("b_source"), F.col(f"b.{bucket}").alias("b_bucket"), F.col("b.before").alias("b_before"))

    first = save(meeting(rows.withColumn("before", F.lit(0).cast("long")), "coarse", F.col("before")), "mixing-coarse")
    within = rows.join(near(first), on("b_source") & (F.col("coarse") == F.col("b_bucket"))).withColumn("before", F.col("b_before")).drop("b_source", "b_bucket", "b_before")
    second = save(meeting(within, "fine", F.col("before")), "mixing-fine")
    edge = rows.join(near(second), on("b_source") & (F.col("fine") == F.col("b_bucket")))
    order = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.col("b_before") + F.sum("size").over(order)).withColumn("in", F.col("run") <= F.col("rest"))
    cut = edge.groupBy("source").agg(F.max(F.when(F.col("in"), F.struct("key", "run"))).alias("last"), F.first("b_bucket").alias("bucket"), F.first("b_before").alias("before"))
    cut = cut.select(F.col("source").alias("c_source"), F.col("last.key").alias("cut"), F.coalesce("last.run", "before").alias("sum_in"), F.col("bucket").alias("cut_bucket"))
    same = edge.join(near(cut), on("c_source")).where(F.col("key") == F.col("cut")).groupBy(F.col("source").alias("e_source")).agg(F.count_if("in").alias("cut_in"), F.count("*").alias("cut_n"))
    cut = save(cut.join(same, F.col("c_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"), "mixing-cuts")

    # where no row of the bucket fits, the last one taken is that of the buckets before
    lower = rows.join(near(cut), on("c_source")).where(F.col("cut").isNull() & (F.col("fine") < F.col("cut_bucket"))).groupBy(F.col("source").alias("l_source")).agg(F.max("key").alias("lower"))

    left = rows.join(near(cut), on("c_source")).withColumn("gap", F.col("rest") - F.col("sum_in"))
    # rows equal to the cut are left only where some of them are
    out = (F.col("fine") > F.col("cut_bucket")) | ((F.col("fine") == F.col("cut_bucket")) & (F.col("cut").isNull() | (F.col("key") > F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("cut_in") < F.col("cut_n")))))
    off = F.abs(F.col("gap") - F.col("size"))
    best = left.where(out & (off < F.col("gap"))).groupBy(F.col("source").alias("f_source")).agg(F.min(F.struct(off.alias("off"), "key")).alias("b")).select("f_source", F.col("b.key").alias("best"))
    per = per.join(cut, F.col("s_source").eqNullSafe(F.col("c_source")), "left").join(best, F.col("s_source").eqNullSafe(F.col("f_source")), "left")
    per = per.join(lower, F.col("s_source").eqNullSafe(F.col("l_source")), "left").withColumn("cut", F.coalesce("cut", "lower"))
    again = F.coalesce(F.col("best") == F.col("cut"), F.lit(False))
    per = save(per.withColumn("cut_in", F.col("cut_in") + again.cast("int")).withColumn("best", F.when(~again, F.col("best"))), "mixing-gaps")
    alike = rows.join(near(per.select("s_source", "best")), on("s_source")).where(F.col("key") == F.col("best")).groupBy(F.col("source").alias("n_source")).agg(F.count("*").alias("best_n"))
    per = per.join(alike, F.col("s_source").eqNullSafe(F.col("n_source")), "left")
    return save(per.select("s_source", "source_size", "target", "c", "cut", "cut_in", "cut_n", "best", "best_n"), "mixing-decisions"), few


def _decided(rows: DataFrame, decisions: DataFrame, copies: int, few: bool, equal: str) -> DataFrame:
    """rows (doc_id, source, size, tie, ...) with source_size, target and copies. equal: a column that orders equal rows.

    Rows that are equal to a source's last one, of which only some are in, and to the one that fills its gap, are numbered;
    there are none but these of which one can't tell by itself.
    """
    rows = _ranked(rows, decisions, copies, few)
    at_cut, at_best = F.coalesce(F.col("key") == F.col("cut"), F.lit(False)), F.coalesce(F.col("key") == F.col("best"), F.lit(False))
    open_ = (at_cut & (F.col("cut_in") < F.col("cut_n"))) | (at_best & (F.col("best_n") > 1))
    below = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)) | at_best
    out = rows.withColumn("copies", (F.col("whole") + below.cast("int")).cast("int"))
    if not decisions.where("cut_in < cut_n or best_n > 1").isEmpty():
        nth = F.row_number().over(W.partitionBy("source", "key").orderBy(equal))
        most = F.when(F.col("key") == F.col("best"), F.lit(1)).otherwise(F.col("cut_in"))
        part = rows.where(open_).withColumn("nth", nth).withColumn("copies", (F.col("whole") + (F.col("nth") <= most).cast("int")).cast("int")).drop("nth")
        out = out.where(~open_).unionByName(part)
    return out.drop("c", "cut", "cut_in", "cut_n", "best", "best_n", "whole", "p", "q", "key")


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row of docs (doc_id, text, source).

    A null or empty text has size 0 and takes 0 words; a very long one is counted whole. A null source is a source, the
    last. Ranks that tie are ordered by id, size and hash of the text; of rows that agree in all of these, any may be the
    one that is taken. Other columns are ignored, whatever their names; an empty table gives none.
    """
    names = {n: n for n in ("doc_id", "source", "size", "tie")}
    sizes = save(_sized(spread(docs.select("doc_id", "text", "source")), names).select(*names), "mixing-sizes")
    decisions, few = cuts(sizes, share, weights, copies)
    out = _decided(sizes, decisions, copies, few, "tie")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def take(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with all columns of docs.

    Every row is taken or left as mix() says of it; texts stay where they are. Of rows that agree in id, size and text of
    which only some are taken, those whose other columns have the smallest hash are. Columns of any other names are kept.
    Null and empty texts, null sources and an empty table are as in mix().
    """
    names = {n: n for n in ("doc_id", "source", "size", "tie")}
    sizes = save(_sized(spread(docs.select("doc_id", "text", "source")), names).select(*names), "mixing-sizes")
    decisions, few = cuts(sizes, share, weights, copies)
    # the row goes along as one column, so that no name of its own can meet one used here
    row = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text"), F.col("source"))
    rows = _sized(row, names).select("row", *names, F.xxhash64(F.col("row").cast("string")).alias("equal"))
    out = _decided(rows, decisions, copies, few, "equal").where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; see mix()."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fills_at FROM s1),
s3 AS (SELECT *, sum(cap) OVER o - cap AS full_, sum(weight) OVER () - sum(weight) OVER o + weight AS open_, sum(source_size) OVER () AS total FROM s2 WINDOW o AS (ORDER BY fills_at, source NULLS LAST)),
s4 AS (SELECT *, (CAST(total AS DOUBLE) * 1.5 - full_) / open_ AS level FROM s3),
s5 AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM s4 WHERE level <= fills_at ORDER BY fills_at, level DESC LIMIT 1)) AS target FROM s4),
l0 AS (SELECT source, length(bin(size)) AS m, sum(size) AS words FROM d GROUP BY ALL),
l1 AS (SELECT l0.*, s5.source_size, s5.target, CAST(sum(words) OVER (PARTITION BY l0.source) - sum(words) OVER o AS DOUBLE) AS above, CAST(sum(m * words) OVER o AS DOUBLE) AS weighed FROM l0 JOIN s5 ON l0.source IS NOT DISTINCT FROM s5.source WINDOW o AS (PARTITION BY l0.source ORDER BY m)),
l2 AS (SELECT *, (target - 2.0::DOUBLE * above) / weighed AS c FROM l1),
l3 AS (SELECT * EXCLUDE (c), coalesce(max(CASE WHEN words > 0 AND c * CAST(m AS DOUBLE) <= 2 THEN (m, c) END) OVER (PARTITION BY source)[2], 2.0::DOUBLE) AS c FROM l2),
s6 AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(c) AS c, greatest(0.0::DOUBLE, any_value(target) - CAST(sum(floor(least(2.0::DOUBLE, c * CAST(m AS DOUBLE))) * CAST(words AS DOUBLE)) AS DOUBLE)) AS rest FROM l3 GROUP BY source),
r AS (SELECT d.doc_id, d.size, s6.*, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, c * CAST(length(bin(size)) AS DOUBLE)) ELSE 0.0::DOUBLE END AS expected, (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
p AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM r),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rnk FROM p),
t AS (SELECT *, row_number() OVER o AS nth, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM q WHERE p > 0 WINDOW o AS (PARTITION BY source ORDER BY rnk, doc_id, size)),
g AS (SELECT *, rest - coalesce(max(CASE WHEN run <= rest THEN run END) OVER (PARTITION BY source), 0) AS gap FROM t),
b AS (SELECT *, min(CASE WHEN run > rest AND abs(gap - size) < gap THEN (abs(gap - size), nth) END) OVER (PARTITION BY source) AS best FROM g),
c AS (SELECT doc_id, size, source_size, target, source, CAST(whole + CASE WHEN run <= rest OR nth = best[2] THEN 1 ELSE 0 END AS INTEGER) AS copies FROM b
  UNION ALL SELECT doc_id, size, source_size, target, source, CAST(whole AS INTEGER) FROM q WHERE NOT p > 0)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, copies FROM c
"""
