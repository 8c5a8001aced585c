"""Overlap resolution, inside the JVM: the longest span wins, then the most specific, the surest and the first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.operators.detect import SPANS


def _order(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, then: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(then)

    last = by(a["start"], b["start"], by(a["ord"], b["ord"], F.lit(0)))
    return by(b["byte_len"], a["byte_len"], by(b["specificity"], a["specificity"], by(b["confidence"], a["confidence"], last)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column) -> Column:
    """Disjoint spans by start. Spans that agree in length, rank, confidence and start are settled by emission."""
    ranked = F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"]), _order)
    kept = F.aggregate(ranked, F.array().cast(SPANS), lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
