"""Text functions, as columns that stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.kinds import SPACE

#: The written form of a placeholder. Fixed value.
PLACEHOLDER = r"\[\[([A-Z0-9][A-Z0-9_]*)_(\d+)\]\]"
#: Unicode white space without the line feed.
BLANK = SPACE.replace("\\t-\\r", "\\t\\x0b-\\r")


def tidy(text: Column) -> Column:
    """Lines without trailing space, one blank line at most between others, none at the ends, a line feed at the end."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), f"[{BLANK}]+(?=\n|\\z)", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "\\A\n+|\n+\\z", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def tidy_text(text: str) -> str:
    t = re.sub(f"[{BLANK}]+(?=\n|\\Z)", "", text.replace("\r\n", "\n"))
    t = re.sub("\n{3,}", "\n\n", t).strip("\n")
    return t + "\n" if t else ""


def placeholder(tag: Column, seq: Column) -> Column:
    return F.concat(F.lit("[["), tag, F.lit("_"), seq.cast("string"), F.lit("]]"))


def placeholder_tag(text: Column) -> Column:
    return F.regexp_extract(text, PLACEHOLDER, 1)


def placeholder_seq(text: Column) -> Column:
    """The number of a placeholder; null where it is no 64-bit one."""
    return F.regexp_extract(text, PLACEHOLDER, 2).try_cast("bigint")


def unwrap(text: Column) -> Column:
    """[[TAG_n]] as TAG_n, for file names."""
    return F.regexp_replace(text, PLACEHOLDER, "$1_$2")


def quoted(text: Column) -> Column:
    """A name for a message: no control characters, sixty characters and an ellipsis at most."""
    t = F.regexp_replace(text, "\\p{Cc}", "")
    return F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 60), F.lit("…"))).otherwise(t)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{Cc}", " ")


def visible(text: Column) -> Column:
    """How many characters are no white space."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]", ""))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def region_of_locale(locale: Column) -> Column:
    """FR of fr_FR.UTF-8; null where no two-letter region is named."""
    r = F.upper(F.regexp_extract(locale, "^[A-Za-z]+[_-]([A-Za-z]{2})(?:[.@].*)?$", 1))
    return F.when(r != "", r)
