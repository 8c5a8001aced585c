"""Rewriting: values to placeholders and back, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import PLACEHOLDER


def apply(text: Column, spans: Column) -> Column:
    """text with each span (start, end, placeholder; disjoint, by start) replaced, in one pass."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], F.array(gap, s["placeholder"])).alias("out"), s["end"].alias("at"))

    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, start, step, tail)


def placeholders(text: Column) -> Column:
    """All placeholders of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def restore(docs: DataFrame, values: DataFrame, id: str = "doc_id", text: str = "text", marked: bool = False, opened: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with known placeholders replaced, and the columns restored and unknown: how many were and weren't.

    values: tag, seq, value. Each placeholder of the input is looked up once; what it is replaced by is not searched
    again. Unknown ones, and numbers beyond 64 bits, stay. What is put into a text is found by the SHA-256 of that text,
    so neither ids that repeat nor the order in which rows are computed can mix texts up; equal texts are looked up once.
    Documents without placeholders are not shuffled; if only those that are `marked` by one are asked for, they are left out.
    `id` is not needed and stays for callers that name it. opened: gives value to rows that have the other columns of values,
    after they have been looked up.
    """
    has = F.coalesce(F.col(text).rlike(PLACEHOLDER), F.lit(False))
    hits = docs.where(has).withColumn("__key", F.sha2(F.col(text).cast("binary"), 256))
    once = hits.select("__key", placeholders(F.col(text)).alias("marks")).dropDuplicates(["__key"])
    each = once.select("__key", F.posexplode("marks").alias("nth", "mark"))
    each = each.select("__key", "nth", "mark", F.regexp_extract("mark", PLACEHOLDER, 1).alias("tag"), F.regexp_extract("mark", PLACEHOLDER, 2).try_cast("bigint").alias("seq"))
    if opened is None:
        found = each.join(values.select("tag", "seq", "value"), ["tag", "seq"], "left")
    else:
        found = opened(each.join(values, ["tag", "seq"], "left"))
    marks = found.groupBy("__key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("value", "mark").alias("to")))), lambda x: x["to"]).alias("__to"),
        F.count("value").cast("int").alias("restored"), F.count_if(F.col("value").isNull()).cast("int").alias("unknown"),
    )
    gaps = F.split(F.col(text), PLACEHOLDER, -1)
    whole = F.concat_ws("", F.flatten(F.zip_with(gaps, F.col("__to"), lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))))
    done = hits.join(marks, "__key").withColumn(text, whole).select(*docs.columns, "restored", "unknown")
    if marked:
        return done
    return done.unionByName(docs.where(~has).withColumn("restored", F.lit(0)).withColumn("unknown", F.lit(0)))
