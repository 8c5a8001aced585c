"""Where cleaned texts go: names, collisions, and writers that keep exact file names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.kinds import SPACE
from palimpsest.functions.text import unwrap
from palimpsest.sources.formats import OTHER_SUFFIX, SUFFIXES


class CollisionError(ValueError):
    pass


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.when(name.rlike("^.+\\.[^.]*$") & ~name.rlike("^\\.[^.]*$"), F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name)


def suffix(fmt: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in SUFFIXES.items():
        out = out.when(fmt == k, v)
    return out.otherwise(OTHER_SUFFIX)


def sheet_fragment(name: Column, index: Column) -> Column:
    """A sheet's name as part of a file name; sheet<N+1> where nothing usable is left."""
    t = F.regexp_replace(F.regexp_replace(name, '[/\\\\:*?"<>|\\[\\]]|\\p{Cc}', "_"), f"^[{SPACE}]+|[{SPACE}]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, "^\\.+", ""), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(t == "", F.concat(F.lit("sheet"), (index + 1).cast("string"))).otherwise(t)


def unique_fragments(sheets: DataFrame, book: str = "input_ord", order: str = "sheet_index", name: str = "fragment") -> DataFrame:
    """sheets with fragments that differ within a workbook even if case is ignored: _2, _3, ... in order. A workbook is small."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, used, out = f.sort_values(order), set(), []
        for base in f[name]:
            pick, k = base, 2
            while pick.lower() in used:
                pick, k = f"{base}_{k}", k + 1
            used.add(pick.lower())
            out.append(pick)
        return f.assign(**{name: out})

    return sheets.groupBy(book).applyInPandas(run, sheets.schema)


def destination(path: Column, root: Column, fmt: Column, name: Column, fragment: Column, out_dir: str | None) -> Column:
    """<stem>[.<fragment>]<suffix> beside the input, or below out_dir as the input lies below its root."""
    file = F.concat(name, F.when(fragment.isNotNull(), F.concat(F.lit("."), fragment)).otherwise(""), suffix(fmt))
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    if out_dir is None:
        return F.concat(folder, file)
    top = out_dir.rstrip("/") + "/"
    below = F.regexp_replace(F.substr(folder, F.length(F.regexp_replace(root, "/+$", "")) + 1), "^/+", "")
    return F.concat(F.lit(top), F.when(root.isNull(), "").otherwise(below), file)


def redacted_stem(cleaned: Column) -> Column:
    return unwrap(cleaned)


def ensure_distinct(named: DataFrame, column: str = "destination") -> None:
    """Raises before anything is numbered or written if two outputs would be one file, case being ignored."""
    clash = named.groupBy(F.lower(column).alias("d")).agg(F.count("*").alias("n"), F.min(column).alias("first")).where("n > 1").take(1)
    if clash:
        raise CollisionError(f"{clash[0].n} inputs would be written to {clash[0].first}")


def write_atomic(path: str, data: bytes) -> None:
    """A sibling is written and renamed, so readers see the old file or the new one."""
    part = f"{os.path.dirname(path) or '.'}/.{uuid.uuid4().hex}"
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def write(named: DataFrame, column: str = "destination", text: str = "text") -> DataFrame:
    """Writes each row's text under its exact name, on a file system that executors share; returns what was written. Reruns agree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, t in zip(f[column], f[text], strict=True):
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                write_atomic(path, t.encode())
            yield pd.DataFrame({column: f[column], "bytes": [len(t.encode()) for t in f[text]]})

    return named.select(column, text).mapInPandas(run, f"{column} string, bytes long")
