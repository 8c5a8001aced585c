"""Configuration: strict TOML, found upwards from a folder."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from palimpsest.functions.kinds import CUSTOM, collapse, parse_kind
from palimpsest.functions.phone import PLANS

#: Defaults of the keys.
NER_ENABLED, NER_THRESHOLD, REDACT_FILENAMES = True, 0.15, True
NAME = "palimpsest.toml"
KEYS = {"regions", "ocr_languages", "ner_enabled", "ner_threshold", "redact_filenames", "allowlist", "denylist", "patterns"}
#: Syntax that a linear-time engine lacks and that therefore no pattern may use.
LOOKAROUND = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|\(\?P=|[*+?}]\+")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    term: str
    kind: str
    custom: str | None
    case_sensitive: bool = False

    @property
    def pattern(self) -> str:
        """The term as written, bounded only on the sides that end in a word character."""
        word = lambda c: c.isalnum() or c == "_"
        body = ("\\b" if word(self.term[0]) else "") + re.escape(self.term) + ("\\b" if word(self.term[-1]) else "")
        return body if self.case_sensitive else f"(?i){body}"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str


@dataclass(frozen=True)
class Config:
    regions: tuple[str, ...] = ()
    ocr_languages: tuple[str, ...] = ()
    ner_enabled: bool = NER_ENABLED
    ner_threshold: float = NER_THRESHOLD
    redact_filenames: bool = REDACT_FILENAMES
    allowlist: frozenset[str] = frozenset()
    denylist: tuple[Term, ...] = ()
    patterns: tuple[Pattern, ...] = field(default=())

    def allows(self, value: str) -> bool:
        return collapse_ends(value).lower() in self.allowlist


def collapse_ends(value: str) -> str:
    """Trimmed of Unicode white space; what is inside stays."""
    core = collapse(value)
    if not core:
        return ""
    first, last = core.split(" ")[0], core.split(" ")[-1]
    return value[value.index(first) : value.rindex(last) + len(last)]


def translate(regex: str) -> str:
    """A pattern of the linear-time dialect for the backtracking engine; look-around and back-references are errors."""
    if LOOKAROUND.search(regex):
        raise ConfigError("look-around, back-references and possessive repetition are not supported")
    out = re.sub(r"\\u\{([0-9A-Fa-f]+)\}|\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1] or m[2], 16))), regex)
    return out.replace("\\z", "\\Z")


def region_of_locale(env: dict[str, str]) -> tuple[str, ...]:
    """The region of LC_ALL, then LANG, if it has two letters."""
    for k in ("LC_ALL", "LANG"):
        if m := re.match(r"[A-Za-z]+_([A-Za-z]{2})(?:[.@]|$)", env.get(k, "")):
            return (m[1].upper(),)
    return ()


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def parse(raw: str, env: dict[str, str] | None = None) -> Config:
    try:
        data = tomllib.loads(raw)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"the configuration is not valid TOML: {e}") from e
    _need(not (odd := set(data) - KEYS), f"unknown key: {', '.join(sorted(odd))}")
    regions = data.get("regions")
    regions = region_of_locale(os.environ if env is None else env) if regions is None else tuple(str(r).upper() for r in regions)
    regions = tuple(r for r in regions if r in PLANS) if data.get("regions") is None else regions
    for r in regions:
        _need(r in PLANS, f"unknown region: {r}")
    threshold = float(data.get("ner_threshold", NER_THRESHOLD))
    _need(0 <= threshold <= 1, "ner_threshold must lie between 0 and 1")
    terms, patterns = [], []
    for t in data.get("denylist", []):
        _need(not (odd := set(t) - {"term", "kind", "case_sensitive"}), f"unknown key in denylist: {', '.join(sorted(odd))}")
        term = collapse_ends(str(t.get("term", "")))
        _need(term != "", "a denylist term is empty")
        terms.append(Term(term, *parse_kind(str(t.get("kind", "organisation"))), bool(t.get("case_sensitive", False))))
    for p in data.get("patterns", []):
        _need(not (odd := set(p) - {"name", "regex"}), f"unknown key in patterns: {', '.join(sorted(odd))}")
        _need("name" in p and "regex" in p, "a pattern needs a name and a regex")
        try:
            import regex

            regex.compile(translate(p["regex"]))
        except (ConfigError, regex.error) as e:
            raise ConfigError(f"pattern {p['name']}: {e}") from e
        patterns.append(Pattern(p["name"], p["regex"]))
    return Config(
        regions, tuple(map(str, data.get("ocr_languages", ()))), bool(data.get("ner_enabled", NER_ENABLED)), threshold, bool(data.get("redact_filenames", REDACT_FILENAMES)),
        frozenset(collapse_ends(str(a)).lower() for a in data.get("allowlist", ())), tuple(terms), tuple(patterns),
    )


def discover(start: str | os.PathLike = ".") -> Path | None:
    """The nearest configuration file at or above a folder."""
    at = Path(start).resolve()
    return next((p / NAME for p in (at, *at.parents) if (p / NAME).is_file()), None)


def load(path: str | os.PathLike | None = None, start: str | os.PathLike = ".") -> Config:
    found = Path(path) if path else discover(start)
    return parse(found.read_text("utf-8")) if found else parse("")


__all__ = ["CUSTOM", "Config", "ConfigError", "Pattern", "Term", "discover", "load", "parse", "translate"]
