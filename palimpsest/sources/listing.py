"""From paths to inputs. Listed on the driver: Spark's own listing hides names that start with _ or . and follows links."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.formats import OUTPUT_SUFFIXES, format_of

SCHEMA = "path string, root string, input_ord long, format string"


@dataclass(frozen=True)
class Input:
    path: str
    root: str | None


def _walk(folder: str, root: str, recursive: bool, found: list[Input]) -> int:
    """Appends a folder's inputs by name and returns how many files were no inputs."""
    skipped = 0
    for e in sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name)):
        if e.name.startswith(".") or e.is_symlink():
            continue
        if e.is_dir():
            skipped += _walk(e.path, root, True, found) if recursive else 0
        elif e.name.endswith(OUTPUT_SUFFIXES):
            continue
        elif format_of(e.path):
            found.append(Input(e.path, root))
        else:
            skipped += 1
    return skipped


def resolve(paths: list[str], recursive: bool = False) -> tuple[list[Input], int]:
    """Files as named, folders by what they hold; and how many files of folders have no supported format."""
    found: list[Input] = []
    skipped = 0
    for p in paths:
        if os.path.isdir(p):
            skipped += _walk(p, p, recursive, found)
        else:
            found.append(Input(p, None))
    return found, skipped


def frame(spark: SparkSession, inputs: list[Input]) -> DataFrame:
    return spark.createDataFrame([(i.path, i.root, n, format_of(i.path)) for n, i in enumerate(inputs)], SCHEMA)
