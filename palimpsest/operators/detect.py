"""Recognisers: from text to spans, by one Arrow-fed scan.

A recogniser that has a validator goes on differently after a rejected candidate than a search for all matches would: the
parts inside it are tried, longest first, and the scan resumes behind what they claimed. That is why detection is a scan
in Python and not a chain of expressions. Each text passes cheap tests first, so most texts meet few patterns.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.config import Config, translate
from palimpsest.functions import checksums, patterns
from palimpsest.functions.kinds import CUSTOM, RANKS, SPACE
from palimpsest.functions.phone import is_phone

#: start and end count characters; byte_len is the UTF-8 length by which the longer of two spans is told.
SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("byte_len", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("custom", T.StringType()),
        T.StructField("specificity", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        T.StructField("ord", T.IntegerType()),
    ]
)
SPANS = T.ArrayType(SPAN)
#: A further layer of recognition: text -> [(start, end, kind, custom, confidence)]; none by default.
Layer = Callable[[str], list[tuple[int, int, str, str | None, float]]]

_LONG_DIGITS = re.compile(r"\d(?:[^\w\n]{0,3}\d){6}")
_DIGIT = re.compile(r"\d")
#: What any IBAN, street or postcode holds at least.
_COUNTRY, _SPACE, _CAPITAL = re.compile(r"[^\W\d_]{2}\d\d"), re.compile(f"[{SPACE}]"), re.compile("[A-ZÀ-Þ]")
_GROUPS = re.compile(r"[^\W_]+")


#: Rows that are handed back at a time: what a worker holds besides a batch doesn't grow with the batch.
SLICE = 1_000


class Scanner:
    """All recognisers of a configuration, or those named in `only`, compiled once per worker."""

    def __init__(self, config: Config, layer: Layer | None = None, only: tuple[str, ...] | None = None):
        self.config, self.layer = config, layer
        luhn = lambda t: checksums.is_luhn(checksums.digits_of(t))
        siret = lambda t: luhn(t) and checksums.is_luhn(checksums.digits_of(t)[:9])
        valid = {
            "iban": checksums.is_iban, "card": luhn, "siret": siret, "siren": luhn, "phone": lambda t: is_phone(t, config.regions),
            "ipv4": lambda t: checksums.is_ip(t, 4), "ipv6": lambda t: checksums.is_ip(t, 6),
        }
        self.rules = [(name, kind, None, regex.compile(p), valid.get(name)) for name, kind, p in patterns.ORDER]
        self.rules += [("custom", CUSTOM, p.name, regex.compile(translate(p.regex)), None) for p in config.patterns]
        self.rules += [("denylist", t.kind, t.custom, regex.compile(t.pattern), None) for t in config.denylist]
        self.rules = [r for r in self.rules if only is None or r[0] in only]

    def may(self, text: str) -> set[str]:
        """Recognisers that a text can hold anything for, by tests that cost far less than the patterns."""
        out = {"custom", "denylist"}
        if "@" in text:
            out.add("email")
        if text.count(":") >= 2:
            out.add("ipv6")
        if _DIGIT.search(text):
            if _COUNTRY.search(text):
                out.add("iban")
            if _SPACE.search(text):
                out.add("street")
            if _CAPITAL.search(text):
                out.add("postcode")
            if text.count(".") >= 3:
                out.add("ipv4")
            if _LONG_DIGITS.search(text):
                out.update(("card", "siret", "siren", "phone"))
        return out

    def spans(self, text: str) -> list[tuple]:
        found: list[tuple[int, int, str, str | None, float]] = []
        may = self.may(text)
        for name, kind, custom, pattern, valid in self.rules:
            if name in may:
                found += [(i, j, kind, custom, 1.0) for i, j in scan(text, pattern, valid)]
        if self.layer and text.strip():
            found += self.layer(text)
        out = []
        for n, (i, j, kind, custom, confidence) in enumerate(found):
            value = text[i:j]
            if not (self.config.allowlist and self.config.allows(value)):
                out.append((i, j, len(value.encode("utf-8", "surrogatepass")), kind, custom, RANKS[kind], value, confidence, n))
        return out


def scan(text: str, pattern: regex.Pattern, valid: Callable[[str], bool] | None) -> Iterator[tuple[int, int]]:
    """Ranges that match and validate, from left to right."""
    at = 0
    while at <= len(text) and (m := pattern.search(text, at)):
        i, j = m.span()
        if valid is None or valid(m[0]):
            if j > i:
                yield i, j
            at = max(j, i + 1)
            continue
        claimed = list(parts(m[0], valid))
        yield from ((i + a, i + b) for a, b in claimed)
        at = max(i + claimed[-1][1] if claimed else j, i + 1)


def parts(candidate: str, valid: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Inside a rejected candidate: for each first group of letters and digits, the longest run of groups that validates."""
    groups = [m.span() for m in _GROUPS.finditer(candidate)]
    k = 0
    while k < len(groups):
        for last in range(len(groups) - 1, k - 1, -1):
            a, b = groups[k][0], groups[last][1]
            if (a, b) != (0, len(candidate)) and valid(candidate[a:b]):
                yield a, b
                k = last
                break
        k += 1


@lru_cache(maxsize=8)
def scanner(config: Config, layer: Layer | None = None, only: tuple[str, ...] | None = None) -> Scanner:
    return Scanner(config, layer, only)


def settled(spans: list[tuple]) -> list[tuple]:
    """What resolve makes of a text's spans, by start: the longest wins, then the most specific, the surest and the first."""
    if len(spans) < 2:
        return [s for s in spans if s[1] > s[0]]
    starts, kept = [], []
    for s in sorted((s for s in spans if s[1] > s[0]), key=lambda s: (-s[2], -s[5], -float(np.float32(s[7])), s[0], s[8])):
        k = bisect(starts, s[0])
        if (k == 0 or kept[k - 1][1] <= s[0]) and (k == len(kept) or s[1] <= kept[k][0]):
            starts.insert(k, s[0])
            kept.insert(k, s)
    return kept


_ARROW = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float32(), pa.int32())


def _listed(found: list[list[tuple]]) -> pa.Array:
    """Spans of several texts as an array of lists, built by columns."""
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    fields = zip(*(s for spans in found for s in spans), strict=True) if ends[-1] else ((),) * len(_ARROW)
    columns = [pa.array(c, t) for c, t in zip(fields, _ARROW, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, SPAN.fieldNames()))


def detect(docs: DataFrame, config: Config, text: str = "text", out: str = "spans", layer: Layer | None = None, only: tuple[str, ...] | None = None, settle: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with a column of the spans of one of its text columns, in the order of emission; a null text has none.

    only: names of recognisers. settle: no spans that overlap, by start, as resolve leaves them. keep: the columns of docs that are
    handed on, all by default; texts that nothing reads again need not travel back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(config, layer, only).spans
        each = (lambda t: settled(find(t))) if settle else find
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                texts = b.column(b.schema.get_field_index(text))
                found = [each(t) if (t := x.as_py()) else [] for x in texts]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), _listed(found)], [*kept, out])

    kept = docs.columns if keep is None else [c for c in docs.columns if c in keep]
    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name in kept), T.StructField(out, SPANS)]))


def native_matches(text: Column, pattern: str, kind: str, custom: str | None = None) -> Column:
    """Spans of a pattern without a validator, by expressions alone: the text between matches gives their places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))

    def step(acc: Column, x: Column) -> Column:
        i = acc["at"] + x["g"]
        j = i + F.length(x["h"])
        span = F.struct(i.alias("start"), j.alias("end"), F.octet_length(x["h"]).alias("byte_len"), F.lit(kind).alias("kind"), F.lit(custom).cast("string").alias("custom"), F.lit(RANKS[kind]).alias("specificity"), x["h"].alias("text"), F.lit(1.0).cast("float").alias("confidence"), F.size(acc["out"]).alias("ord"))
        return F.struct(j.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])
