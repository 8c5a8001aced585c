"""Office archives: text documents, slides and workbooks of both families."""

from __future__ import annotations

import datetime as dt
import re

from palimpsest.sources.formats import ConversionError
from palimpsest.sources.readers.markup import archive, part, runs, walk

TEXT_NS = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
#: More spaces than this in one element are taken for a mistake: one space.
SPACE_RUN = 4096


def _whole(text: str, kind: str) -> str:
    if not text.strip():
        raise ConversionError(f"this .{kind} contains no text that can be read; if its content is images, read those separately")
    return text


def docx(data: bytes) -> str:
    """Headers, the body, then footers, notes and comments."""
    z = archive(data, "docx")
    names = {n: m for n in z.namelist() if n.startswith("word/") and "/" not in (m := n[5:].lower()) and m.endswith(".xml")}
    body = [n for n, m in names.items() if m == "document.xml"]
    if not body:
        raise ConversionError("this .docx has no body; it may be an older .doc renamed")
    of = lambda *starts: sorted(n for n, m in names.items() if m.startswith(starts))
    order = of("header") + body + of("footer", "footnotes", "endnotes", "comments")
    return _whole("".join(runs(part(z, n), {"t"}, {"p"}) for n in order), "docx")


def pptx(data: bytes) -> str:
    """Slides, speaker notes and comments, by the numbers in their names; layouts and masters are no content."""
    z = archive(data, "pptx")

    def of(folder: str) -> list[str]:
        own = [n for n in z.namelist() if n.startswith(folder) and "/" not in n[len(folder) :] and n.lower().endswith(".xml")]
        return sorted(own, key=lambda n: (int((re.search(r"(\d+)[^\d]*$", n) or [0, 0])[1]), n))

    slides = of("ppt/slides/")
    if not slides:
        raise ConversionError("this .pptx has no slides; it may be an older .ppt renamed")
    out = [runs(part(z, n), {"t"}, {"p"}) for n in slides + of("ppt/notesSlides/")]
    out += [runs(part(z, n), {"t", "text"}, {"p", "text"}) for n in of("ppt/comments/")]
    return _whole("".join(out), "pptx")


class _OpenText:
    """Text of an OpenDocument part. Characters run on only directly inside text elements of a paragraph; all else is a line."""

    def __init__(self):
        self.out, self.holders, self.inline = "", [], []
        self.skipped, self.bounded = 0, False

    def line(self) -> None:
        if self.out and not self.out.endswith("\n"):
            self.out += "\n"

    def start(self, ns: str, name: str, attributes: dict) -> None:
        if name in ("binary-data", "script"):
            self.skipped += 1
        elif name in ("p", "h"):
            self.holders.append("paragraph")
        elif name in ("annotation", "note", "change-info"):
            self.holders.append("region")
        elif not self.skipped:
            self.out += {"tab": "\t", "line-break": "\n", "s": self.spaces(attributes)}.get(name, "")
        # the childless ones stand for characters of the running text and bound nothing
        runs_on = ns == TEXT_NS and self.holders[-1:] == ["paragraph"]
        self.inline.append(runs_on)
        self.bounded |= not runs_on

    @staticmethod
    def spaces(attributes: dict) -> str:
        n = attributes.get("c", "1")
        return " " * (int(n) if n.isdigit() and int(n) <= SPACE_RUN else 1)

    def end(self, ns: str, name: str) -> None:
        self.bounded |= not (self.inline.pop() if self.inline else False)
        if name in ("binary-data", "script"):
            self.skipped -= 1
        elif name in ("p", "h"):
            self.holders.pop()
            self.line()
            self.bounded = False
        elif name in ("annotation", "note", "change-info"):
            self.holders.pop()

    def text(self, chars: str) -> None:
        inline = bool(self.inline) and self.inline[-1]
        if self.skipped or not inline and not chars.strip():
            return
        if self.bounded:
            self.line()
            self.bounded = False
        self.out += chars


def odt(data: bytes) -> str:
    """The content, then what styles hold: page headers and footers."""
    z = archive(data, "odt")
    if "content.xml" not in z.namelist():
        raise ConversionError("this .odt has no content")
    out = ""
    for n in ("content.xml", "styles.xml"):
        if n in z.namelist():
            t = _OpenText()
            walk(part(z, n), t.start, t.end, t.text)
            out += t.out
    return _whole(out, "odt")


#: Number formats of workbooks that are dates or times. Fixed values.
DATES = set(range(14, 23)) | set(range(45, 48))
_DATE_CODE = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def _number(raw: str) -> str:
    v = float(raw)
    return f"{v:.0f}" if v.is_integer() and abs(v) < 1e15 else repr(v)


def xlsx(data: bytes) -> list[tuple[int, str, str]]:
    """(index, name, text) of each sheet that holds a value: cells by tabs, rows by lines, empty rows left out."""
    z = archive(data, "xlsx")
    names = set(z.namelist())
    if "xl/workbook.xml" not in names:
        raise ConversionError("not a readable spreadsheet")
    sheets, targets, shared, styles, formats, date1904 = [], {}, [], [], {}, False

    def book(_, n, a):
        nonlocal date1904
        if n == "sheet":
            sheets.append((a.get("name", ""), a.get("id", "")))
        elif n == "workbookPr":
            date1904 = a.get("date1904") in ("1", "true")

    nothing = lambda *_: None
    walk(part(z, "xl/workbook.xml"), book, nothing, nothing)
    if "xl/_rels/workbook.xml.rels" in names:
        walk(part(z, "xl/_rels/workbook.xml.rels"), lambda _, n, a: targets.__setitem__(a.get("Id"), a.get("Target", "")) if n == "Relationship" else None, nothing, nothing)
    if "xl/sharedStrings.xml" in names:
        state = {"in": False, "ph": 0}

        def s_start(_, n, __):
            if n == "si":
                shared.append("")
            state["in"] |= n == "t"
            state["ph"] += n == "rPh"

        def s_end(_, n):
            state["in"] &= n != "t"
            state["ph"] -= n == "rPh"

        def s_text(t):
            if state["in"] and not state["ph"]:
                shared[-1] += t

        walk(part(z, "xl/sharedStrings.xml"), s_start, s_end, s_text)
    if "xl/styles.xml" in names:
        inside = []

        def y_start(_, n, a):
            inside.append(n)
            if n == "numFmt":
                formats[int(a.get("numFmtId", 0))] = a.get("formatCode", "")
            elif n == "xf" and "cellXfs" in inside:
                styles.append(int(a.get("numFmtId", 0)))

        walk(part(z, "xl/styles.xml"), y_start, lambda *_: inside.pop(), nothing)

    def dated(style: str) -> bool:
        k = styles[int(style)] if style.isdigit() and int(style) < len(styles) else 0
        return k in DATES or k in formats and bool(re.search("[dmyhs]", _DATE_CODE.sub("", formats[k].lower())))

    def value(kind: str, style: str, raw: str, inline: str) -> str:
        if kind == "s":
            return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
        if kind == "inlineStr":
            return inline
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind in ("str", "d", "e") or not raw:
            return raw
        if dated(style):
            day = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
            return str(day + dt.timedelta(seconds=round(float(raw) * 86400)))
        return _number(raw)

    out = []
    for index, (name, rid) in enumerate(sheets):
        target = targets.get(rid, f"worksheets/sheet{index + 1}.xml")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in names:
            raise ConversionError("a sheet of the workbook is missing")
        rows, cell = {}, {}

        def start(_, n, a, cell=cell, rows=rows):
            if n == "row":
                cell["row"] = int(a["r"]) if a.get("r", "").isdigit() else cell.get("row", 0) + 1
                cell["col"] = 0
            elif n == "c":
                letters = re.match("[A-Za-z]*", a.get("r", ""))[0].upper()
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                cell.update(col=col or cell.get("col", 0) + 1, kind=a.get("t", "n"), style=a.get("s", ""), v="", t="", on=None)
            elif n in ("v", "t"):
                cell["on"] = n

        def end(_, n, cell=cell, rows=rows):
            if n in ("v", "t"):
                cell["on"] = None
            elif n == "c":
                got = value(cell["kind"], cell["style"], cell["v"], cell["t"])
                if got:
                    rows.setdefault(cell["row"], {})[cell["col"]] = got

        def text(s, cell=cell):
            if cell.get("on"):
                cell[cell["on"]] += s

        walk(part(z, path), start, end, text)
        if rows:
            first, last = min(min(r) for r in rows.values()), max(max(r) for r in rows.values())
            out.append((index, name, "".join("\t".join(rows[r].get(c, "") for c in range(first, last + 1)) + "\n" for r in sorted(rows))))
    if not out:
        raise ConversionError("the workbook contains no cell values to read")
    return out
