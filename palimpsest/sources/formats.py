"""Formats by extension, and what cleaned files are called."""

from __future__ import annotations

#: Extensions and formats, in order of declaration.
FORMATS = {
    "txt": "text", "text": "text", "md": "text", "markdown": "text", "csv": "csv", "tsv": "tsv", "docx": "docx", "eml": "eml", "odt": "odt",
    "pptx": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image",
}
#: Suffixes of cleaned files by format; all others take the last.
SUFFIXES = {"csv": ".clean.csv", "tsv": ".clean.tsv", "xlsx": ".clean.tsv"}
OTHER_SUFFIX = ".clean.md"
OUTPUT_SUFFIXES = (".clean.md", ".clean.tsv", ".clean.csv")


class ConversionError(ValueError):
    """A document whose text can't be given in full is refused."""


def format_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return FORMATS.get(name.rsplit(".", 1)[-1].lower()) if "." in name.lstrip(".") else None


def supported(ocr: bool = False) -> list[str]:
    return [e for e, f in FORMATS.items() if ocr or f != "image"]


def suffix_of(fmt: str | None) -> str:
    return SUFFIXES.get(fmt or "", OTHER_SUFFIX)
