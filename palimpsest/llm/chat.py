"""Multi-party perspective rotation: one rendering of a dialogue for each of its participants. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import table

#: The role that addresses everyone and is no participant.
SYSTEM = "system"
#: Turns of a part, about. Renderings of more are given in parts, each a row, so that no task gathers an unbounded one.
PART = 4096
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def escaped(text: Column) -> Column:
    """A text in which no mark can be read: "<|" becomes "<\\|", and one backslash is added to those that stand so already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def named(role: Column) -> Column:
    """A speaker's name within a mark: signs that end one, and line breaks, as their percent codes; different ones differ."""
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    for sign, code in (("|", "%7C"), ("\n", "%0A"), ("\r", "%0D")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """One row per conversation and participant: conv_id, perspective, part, starts_at, n_turns, n_own, rendered, mask.

    turns: conv_id, turn, role, text; other columns are ignored, whatever their names. In each rendering the
    participant's own turns are headed "assistant", the system's "system", and every other speaker's "user name=<role>".
    mask lists the character spans [start, end) of the assistant's texts with their end marks, as "start-end" joined by
    commas: what is learnt. Texts and names are escaped, so that they can't forge a turn.

    A rendering of at most `part` turns is one row, of part 0. A longer one is cut between turns into several rows; put
    together in the order of `part` they are the whole rendering, with every turn once. starts_at says where a part begins
    in it; spans count from the beginning of the row's own text. A part has no more than `part` turns beside those that
    share one turn number.

    Turns are ordered by number, then speaker, then text; repeated rows are repeated turns. A null text is empty, a null
    role is the speaker "unknown", a null turn comes first, a null conv_id is a conversation of its own. A very long text
    is one turn. A conversation with the system alone has no participant and no row. An empty table gives none.
    Participants are those of the whole conversation: one who is silent in a part still gets it, with an empty mask.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # long conversations, by their counts alone: how many turns come before each number
    long = t.groupBy(F.col("conv_id").alias("l_conv")).agg(F.count("*").alias("turns")).where(F.col("turns") > part).select("l_conv")
    before = W.partitionBy("b_conv").orderBy(F.col("b_turn").asc_nulls_first())
    each = t.join(long, F.col("conv_id").eqNullSafe(F.col("l_conv")), "left_semi").groupBy(F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn")).agg(F.count("*").alias("n"))
    parts = each.select("b_conv", "b_turn", F.floor((F.sum("n").over(before) - F.col("n")) / part).alias("part"))
    placed = t.join(parts, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("turn").eqNullSafe(F.col("b_turn")), "left").withColumn("part", F.coalesce("part", F.lit(0)).cast("int"))
    said = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    said = said.withColumn("said", F.transform("said", lambda x: F.struct(x["role"].alias("role"), named(x["role"]).alias("name"), escaped(x["text"]).alias("text"))))
    who = t.where(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("w_conv")).agg(F.collect_set("role").alias("who"))
    views = said.join(who, F.col("conv_id").eqNullSafe(F.col("w_conv"))).select("conv_id", "part", "said", F.explode("who").alias("perspective"))

    def head(x: Column) -> Column:
        other = F.concat(F.lit("<|user name="), x["name"], F.lit("|>\n"))
        return F.when(x["role"] == F.col("perspective"), OPEN.format("assistant")).when(x["role"] == SYSTEM, OPEN.format("system")).otherwise(other)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(head(x))
        end = begin + F.length(x["text"]) + len(CLOSE)
        mine = F.when(x["role"] == F.col("perspective"), F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], mine).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate("said", start, step, lambda acc: acc["spans"])
    rendered = F.concat_ws("", F.transform("said", lambda x: F.concat(head(x), x["text"], F.lit(CLOSE))))
    done = views.select("conv_id", "perspective", "part", F.size("said").alias("n_turns"), rendered.alias("rendered"), spans.alias("spans"))
    # a part's place is the sum of the lengths before it; rows of part 0 have none before them and aren't looked up
    sizes = done.where("part > 0 or n_turns >= %d" % part).select(F.col("conv_id").alias("p_conv"), F.col("perspective").alias("p_who"), F.col("part").alias("p_part"), F.length("rendered").cast("long").alias("n"))
    order = W.partitionBy("p_conv", "p_who").orderBy("p_part")
    at = sizes.withColumn("starts_at", F.sum("n").over(order) - F.col("n")).where("p_part > 0").drop("n")
    done = done.join(at, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("perspective") == F.col("p_who")) & (F.col("part") == F.col("p_part")), "left")
    return done.select("conv_id", "perspective", "part", F.coalesce("starts_at", F.lit(0)).cast("long").alias("starts_at"), "n_turns", F.size("spans").alias("n_own"), "rendered", F.array_join("spans", ",").alias("mask"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders all conversations for all participants; see rotate()."""
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
c AS (SELECT conv_id, turn, role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text, replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') AS name, text AS raw,
  count(*) OVER (PARTITION BY conv_id) AS turns, count(*) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - count(*) OVER (PARTITION BY conv_id, turn) AS before FROM t),
d AS (SELECT *, CAST(CASE WHEN turns > 4096 THEN before // 4096 ELSE 0 END AS INTEGER) AS part FROM c),
m AS (SELECT d.*, w.perspective, d.role = w.perspective AS own, CASE WHEN d.role = w.perspective THEN '<|assistant|>' || chr(10) WHEN d.role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || name || '|>' || chr(10) END AS head FROM d JOIN w ON d.conv_id IS NOT DISTINCT FROM w.conv_id),
n AS (SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS said, row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, raw) AS nth FROM m),
p AS (SELECT *, sum(length(said)) OVER (PARTITION BY conv_id, perspective, part ORDER BY nth) AS ends FROM n),
g AS (SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own) AS INTEGER) AS n_own, string_agg(said, '' ORDER BY nth) AS rendered,
  coalesce(string_agg(CAST(CAST(ends - length(said) + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ends AS BIGINT) AS VARCHAR), ',' ORDER BY nth) FILTER (own), '') AS mask
  FROM p GROUP BY conv_id, perspective, part)
SELECT conv_id, perspective, part, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part) - length(rendered) AS BIGINT) AS starts_at, n_turns, n_own, rendered, mask FROM g
"""
