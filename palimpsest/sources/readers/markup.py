"""Archives of XML parts: bounded reads, and a walk over elements that knows entities and namespaces."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.parsers import expat

from palimpsest.sources.formats import ConversionError

#: Bytes of an uncompressed part that are read at most; a longer one is refused, not cut.
PART_LIMIT = 64 << 20


def archive(data: bytes, kind: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        raise ConversionError(f"not a readable .{kind} archive") from e


def part(z: zipfile.ZipFile, name: str) -> bytes:
    with z.open(name) as f:
        data = f.read(PART_LIMIT + 1)
    if len(data) > PART_LIMIT:
        raise ConversionError(f"a part holds more than {PART_LIMIT >> 20} MiB")
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConversionError("a part is not valid UTF-8") from e
    return data


def local(name: str) -> str:
    return name.rpartition("}")[2].rpartition(":")[2]


def walk(xml: bytes, start: Callable[[str, str, dict], None], end: Callable[[str, str], None], text: Callable[[str], None]) -> None:
    """Calls start(namespace, name, attributes), end(namespace, name) and text(chars). Entities other than XML's own are errors."""
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    p.UseForeignDTD(False)

    def split(name: str) -> tuple[str, str]:
        ns, _, n = name.rpartition("}")
        return ns, n

    def refuse(*_):
        raise ConversionError("an entity that XML does not define")

    p.StartElementHandler = lambda n, a: start(*split(n), {local(k): v for k, v in a.items()})
    p.EndElementHandler = lambda n: end(*split(n))
    p.CharacterDataHandler = text
    p.EntityDeclHandler = refuse
    p.SkippedEntityHandler = refuse
    try:
        p.Parse(xml, True)
    except expat.ExpatError as e:
        raise ConversionError(f"a part is not well-formed XML: {expat.errors.messages[e.code]}") from e


def runs(xml: bytes, holds: set[str], ends_line: set[str]) -> str:
    """Characters inside the elements `holds`, joined as they are; breaks and tabs as written, but not tab-stop definitions."""
    out: list[str] = []
    depth = stops = 0

    def start(_, name, __):
        nonlocal depth, stops
        if name in holds:
            depth += 1
        elif name in ("tabs", "tabLst"):
            stops += 1
        elif name == "tab" and not stops:
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")

    def end(_, name):
        nonlocal depth, stops
        depth -= name in holds
        stops -= name in ("tabs", "tabLst")
        if name in ends_line:
            out.append("\n")

    walk(xml, start, end, lambda s: out.append(s) if depth else None)
    return "".join(out)
