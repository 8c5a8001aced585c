"""Optional layers: a recognition model for names, and text recognition for images. Neither is there by default.

A layer is built from a loader, which runs once in each worker and may fail there: a model that is given but can't be used is
an error, a missing one is no layer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from palimpsest.config import Config
from palimpsest.sources.formats import ConversionError

#: What a model is asked for, and the kinds that its answers are.
LABELS = {"person": "person", "organization": "organisation", "company": "organisation", "address": "address"}
#: The language where nothing is known, and how many installed ones are read at once unasked.
FALLBACK, MOST_UNASKED = "eng", 4

#: text, labels -> (label, found text, start, end, probability); offsets may count bytes or characters.
Predict = Callable[[str, list[str]], list[tuple[str, str, int, int, float]]]


def locate(text: str, found: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Character ranges of what a model found: its range in bytes or in characters if that holds the text, else every occurrence."""
    if not found:
        return
    raw = text.encode()
    if 0 <= start < end <= len(raw) and raw[start:end] == found.encode():
        first = len(raw[:start].decode())
        yield first, first + len(found)
    elif text[start:end] == found:
        yield start, end
    else:
        at = text.find(found)
        while at >= 0:
            yield at, at + len(found)
            at = text.find(found, at + len(found))


@dataclass(frozen=True)
class Names:
    """A layer for detect(): asks a model for LABELS and keeps what reaches the threshold."""

    load: Callable[[], Predict]
    threshold: float

    def __call__(self, text: str) -> list[tuple[int, int, str, str | None, float]]:
        out = []
        for label, found, start, end, p in _loaded(self.load)(text, list(LABELS)):
            if p >= self.threshold and label in LABELS:
                out += [(i, j, LABELS[label], None, float(p)) for i, j in locate(text, found, start, end)]
        return out


_MODELS: dict[Callable[[], Predict], Predict] = {}


def _loaded(load: Callable[[], Predict]) -> Predict:
    """One model per worker; a failed load is tried again at the next text."""
    if load not in _MODELS:
        _MODELS[load] = load()
    return _MODELS[load]


def names(config: Config, load: Callable[[], Predict] | None) -> Names | None:
    return Names(load, config.ner_threshold) if load and config.ner_enabled else None


def select_languages(wanted: tuple[str, ...], installed: list[str] | None) -> str:
    """Languages for text recognition, joined by +. Wanted ones must be installed, where that is known."""
    if wanted:
        if installed is not None and (missing := [w for w in wanted if w not in installed]):
            raise ConversionError(f"no trained data for {', '.join(missing)}; installed: {', '.join(installed) or 'none'}")
        return "+".join(wanted)
    if not installed:
        return FALLBACK
    if len(installed) > MOST_UNASKED:
        return FALLBACK if FALLBACK in installed else installed[0]
    return "+".join(sorted(installed, key=lambda x: (x != FALLBACK, x)))


def verify(path: str, sha256: str, size: int) -> bool:
    """Whether a model file is the one that was pinned."""
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
        return f.tell() == size and digest == sha256
