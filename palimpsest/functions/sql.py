"""The scalar functions for SQL, and detect_spans(text) as a table function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.functions import checksums, kinds, phone, text

#: Name, result, function of one text: a column of each runs over Arrow batches.
SCALARS: tuple[tuple[str, str, Callable], ...] = (
    ("is_luhn", "boolean", lambda v: checksums.is_luhn(v)),
    ("is_iban", "boolean", lambda v: checksums.is_iban(v)),
    ("is_ipv4", "boolean", lambda v: checksums.is_ip(v, 4)),
    ("is_ipv6", "boolean", lambda v: checksums.is_ip(v, 6)),
    ("digits_of", "string", checksums.digits_of),
    ("tidy", "string", text.tidy_text),
    ("sanitise_tag", "string", kinds.sanitise),
)


def register(spark: SparkSession, config: Config | None = None) -> list[str]:
    """Registers the functions in a session and returns their names. In DataFrame code, use the columns of the modules instead."""
    cfg = config or Config()

    def column(f: Callable, result: str):
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return F.pandas_udf(run, result)

    for name, result, f in SCALARS:
        spark.udf.register(name, column(f, result))
    spark.udf.register("is_phone", column(lambda v: phone.is_phone(v, cfg.regions), "boolean"))

    def normalise(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or k is None else kinds.normalise_of(k, v) for k, v in zip(kind, value, strict=True)])

    spark.udf.register("normalise", F.pandas_udf(normalise, "string"))

    class Spans:
        def eval(self, value: str):
            from palimpsest.operators.detect import scanner

            for s in scanner(cfg).spans(value or ""):
                yield s

    spans = F.udtf(Spans, returnType="start int, end int, byte_len int, kind string, custom string, specificity int, text string, confidence float, ord int")
    spark.udtf.register("detect_spans", spans)
    return [*(n for n, _, _ in SCALARS), "is_phone", "normalise", "detect_spans"]
