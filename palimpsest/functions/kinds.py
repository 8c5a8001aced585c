"""The taxonomy of sensitive values: tags, ranks and identities, as columns and as Python functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, tag and specificity of the built-in kinds, in order of declaration.
BUILT_IN = (
    ("person", "PERSON", 3),
    ("organisation", "ORG", 3),
    ("address", "ADDRESS", 1),
    ("phone", "PHONE", 2),
    ("email", "EMAIL", 5),
    ("iban", "IBAN", 5),
    ("credit_card", "CARD", 4),
    ("siren", "SIREN", 3),
    ("siret", "SIRET", 5),
    ("ip_address", "IP", 5),
)
CUSTOM, CUSTOM_SPECIFICITY, CUSTOM_TAG = "custom", 6, "CUSTOM"
TAGS = {k: t for k, t, _ in BUILT_IN}
RANKS = {k: r for k, _, r in BUILT_IN} | {CUSTOM: CUSTOM_SPECIFICITY}
CODES = ("iban", "credit_card", "siren", "siret")
#: Words that name a kind in a term list.
SYNONYMS = {
    "person": "person", "client": "person", "name": "person",
    "organisation": "organisation", "organization": "organisation", "org": "organisation", "provider": "organisation", "company": "organisation",
    "address": "address", "phone": "phone", "email": "email",
}
#: Unicode white space as a class body, for engines whose \s is ASCII or has more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{SPACE}]+")


def parse_kind(word: str) -> tuple[str, str | None]:
    """(kind, custom name) of a term's declared kind; what is no synonym is a custom kind of that name."""
    low = word.lower()
    return (SYNONYMS[low], None) if low in SYNONYMS else (CUSTOM, low)


def sanitise(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", name).upper().strip("_") or CUSTOM_TAG


def tag_of(kind: str, custom: str | None = None) -> str:
    return sanitise(custom or "") if kind == CUSTOM else TAGS[kind]


def collapse(value: str) -> str:
    return _SPACES.sub(" ", value.strip("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"))


def normalise_of(kind: str, value: str) -> str:
    """What two spellings of the same value have in common."""
    if kind == "phone":
        return re.sub(r"[^0-9+]", "", value)
    if kind in CODES:
        return re.sub(r"[^0-9A-Za-z]", "", value).upper()
    return collapse(value).lower()


def tag(kind: Column, custom: Column) -> Column:
    mine = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(custom, F.lit("")), "[^A-Za-z0-9]", "_")), "^_+|_+$", "")
    out = F.when(kind == CUSTOM, F.when(mine == "", CUSTOM_TAG).otherwise(mine))
    for k, t, _ in BUILT_IN:
        out = out.when(kind == k, t)
    return out


def specificity(kind: Column) -> Column:
    out = F.when(kind == CUSTOM, CUSTOM_SPECIFICITY)
    for k, _, r in BUILT_IN:
        out = out.when(kind == k, r)
    return out


def fold(value: Column) -> Column:
    """Trimmed of all Unicode white space, lower-cased."""
    return F.lower(F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def normalise(kind: Column, value: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+", " ")
    return F.when(kind == "phone", F.regexp_replace(value, "[^0-9+]", "")).when(kind.isin(*CODES), F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))).otherwise(F.lower(spaced))
