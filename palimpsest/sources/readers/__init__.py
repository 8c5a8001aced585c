"""From bytes to parts: one per document, or one per sheet of a workbook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.functions.text import tidy_text
from palimpsest.sources.formats import ConversionError, format_of, supported
from palimpsest.sources.readers import mail, office, pdf

Part = tuple[int | None, str | None, str]
PARTS = "path string, root string, input_ord long, format string, part_ord int, sheet_index int, sheet_name string, text string, error string"
#: Reads the text off an image: none by default, and images are refused.
Ocr = Callable[[bytes], str]


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConversionError("not valid UTF-8") from e


def convert(path: str, data: bytes, ocr: Ocr | None = None) -> list[Part]:
    """The parts of a document: (sheet index, sheet name, text). What can't be read in full is a ConversionError."""
    fmt = format_of(path)
    if fmt is None:
        raise ConversionError(f"unsupported file type; supported are {', '.join(supported(ocr is not None))}")
    if fmt == "image":
        if ocr is None:
            raise ConversionError("images are read by an OCR layer, and none is given")
        text = ocr(data)
        if not text.strip():
            raise ConversionError("no text was recognised in the image")
        return [(None, None, tidy_text(text))]
    if fmt == "xlsx":
        return list(office.xlsx(data))
    if fmt in ("csv", "tsv"):
        return [(None, None, _utf8(data))]
    read = {"text": _utf8, "docx": office.docx, "pptx": office.pptx, "odt": office.odt, "eml": mail.eml, "pdf": lambda x: pdf.pdf(x, ocr)}[fmt]
    return [(None, None, tidy_text(read(data)))]


def read(inputs: DataFrame, ocr: Ocr | None = None) -> DataFrame:
    """inputs (path, root, input_ord, format; paths on a file system that all executors see) as parts; a file that can't be read is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                head = (r.path, r.root, r.input_ord, r.format)
                try:
                    with open(r.path, "rb") as file:
                        parts = convert(r.path, file.read(), ocr)
                    rows += [(*head, k, *p, None) for k, p in enumerate(parts)]
                except (ConversionError, OSError) as e:
                    rows.append((*head, 0, None, None, None, f"{r.path}: {e}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])
            yield out.astype({"sheet_index": "Int32"})

    n = inputs.sparkSession.sparkContext.defaultParallelism
    return inputs.select("path", "root", "input_ord", "format").repartition(4 * n).mapInPandas(run, PARTS)
