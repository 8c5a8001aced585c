"""Text of PDF pages whose fonts say what their codes mean; anything else is refused rather than read in part."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from palimpsest.sources.formats import ConversionError

#: Visible characters below which a page counts as thin, and depth to which page trees are followed.
THIN, DEPTH = 8, 32
#: Bytes of an unpacked stream at most, and depth to which forms within forms are followed.
MOST, FORMS = 256 << 20, 12
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|<<|>>|[A-Za-z'\"*]+\d?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflate(head: bytes, body: bytes) -> bytes:
    names = re.findall(rb"/(\w+Decode)\b", head)
    for n in names:
        if n != b"FlateDecode":
            raise ConversionError("a page is compressed in a way that isn't read")
        d = zlib.decompressobj()
        body = d.decompress(body, MOST)
        if d.unconsumed_tail:
            raise ConversionError("a stream is too large to be read in full")
    return body


class _Document:
    def __init__(self, data: bytes):
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for raw in list(self.objects.values()):
            if b"/ObjStm" in raw and (m := _STREAM.match(raw)):
                body = _inflate(m[1], m[2])
                first, n = int(re.search(rb"/First\s+(\d+)", m[1])[1]), int(re.search(rb"/N\s+(\d+)", m[1])[1])
                nums = list(map(int, body[:first].split()[: 2 * n]))
                for k in range(n):
                    stop = nums[2 * k + 3] + first if k + 1 < n else len(body)
                    self.objects.setdefault(nums[2 * k], body[first + nums[2 * k + 1] : stop])

    def entry(self, raw: bytes, key: bytes) -> bytes | None:
        """The value of a key, a reference being followed."""
        m = re.search(rb"/" + key + rb"\b\s*(?:" + _REF + rb"|(<<)|(\[[^\]]*\]|[^/>\[]+))", raw, re.S)
        if not m:
            return None
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        if not m[2]:
            return m[3]
        depth = 0
        for t in re.finditer(rb"<<|>>", raw[m.start(2) :]):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return raw[m.start(2) : m.start(2) + t.end()]
        return raw[m.start(2) :]

    def pages(self) -> list[bytes]:
        root = next((o for o in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", o)), b"")
        m = re.search(rb"/Pages\s+" + _REF, root)
        out: list[bytes] = []

        def visit(num: int, above: bytes, depth: int) -> None:
            raw = self.objects.get(num, b"")
            if depth > DEPTH:
                raise ConversionError("the page tree is too deep")
            own = raw if b"/Resources" in raw else raw + above
            if m := re.search(rb"/Kids\s*\[([^\]]*)\]", raw):
                up = re.search(rb"/Resources\b.*", raw, re.S)
                for k in re.findall(_REF, m[1]):
                    visit(int(k), up[0] if up else above, depth + 1)
            elif re.search(rb"/Type\s*/Page\b", raw):
                out.append(own)

        if m:
            visit(int(m[1]), b"", 0)
        return out

    def stream(self, num: int) -> bytes:
        m = _STREAM.match(self.objects.get(num, b""))
        return _inflate(m[1], m[2]) if m else b""

    def drawn(self, page: bytes) -> dict[bytes, int]:
        """Numbers of the forms and images that a page or form can draw, by name."""
        res = self.entry(page, b"Resources") or page
        return {name: int(num) for name, num in re.findall(rb"/(\S+)\s+" + _REF, self.entry(res, b"XObject") or b"")}

    def text(self, page: bytes, content: bytes, images: list[int], fonts: dict | None = None, depth: int = 0) -> str:
        """The text of a page or form, with that of the forms it draws; images are noted."""
        if depth > FORMS:
            raise ConversionError("forms are nested too deep")
        own = self.fonts(page) if fonts is None or b"/Resources" in page else fonts
        drawn = self.drawn(page)

        def draw(name: bytes) -> str:
            num = drawn.get(name)
            m = _STREAM.match(self.objects.get(num, b""))
            if m is None:
                return ""
            if re.search(rb"/Subtype\s*/Form\b", m[1]):
                return f"\n{self.text(m[1], self.stream(num), images, own, depth + 1)}\n"
            images.append(num)
            return ""

        return _page(content, own, draw)

    def image(self, num: int) -> bytes:
        """An image as its file, where it is kept as one."""
        m = _STREAM.match(self.objects[num])
        if re.findall(rb"/(\w+Decode)\b", m[1]) not in ([b"DCTDecode"], [b"JPXDecode"]):
            raise ConversionError("an image is packed in a way that isn't read")
        return m[2]

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str] | None]:
        """Maps from codes to text by font name; None: one byte is one Latin character."""
        out: dict[bytes, dict[bytes, str] | None] = {}
        res = self.entry(page, b"Resources") or page
        table = self.entry(res, b"Font") or b""
        for name, num in re.findall(rb"/(\S+)\s+" + _REF, table):
            font = self.objects.get(int(num), b"")
            if m := re.search(rb"/ToUnicode\s+" + _REF, font):
                out[name] = _cmap(self.stream(int(m[1])))
            elif b"/Type0" in font:
                raise ConversionError("a font doesn't say what its characters are")
            else:
                out[name] = None
        return out


def _cmap(body: bytes) -> dict[bytes, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        out.update((bytes.fromhex(a.decode()), text(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for lo, hi, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            n = len(lo) // 2
            each = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for k in range(min(int(hi, 16) - int(lo, 16) + 1, 65536)):
                to = text(each[k]) if k < len(each) else text(one)[:-1] + chr(ord(text(one)[-1]) + k) if one else ""
                out[(int(lo, 16) + k).to_bytes(n, "big")] = to
    return out


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _shown(raw: bytes, font: dict[bytes, str] | None) -> str:
    if font is None:
        return raw.decode("cp1252", "replace")
    n = len(next(iter(font), b"x"))
    return "".join(font.get(raw[i : i + n], "") for i in range(0, len(raw), n))


def _page(content: bytes, fonts: dict[bytes, dict[bytes, str] | None], draw: Callable[[bytes], str] = lambda name: "") -> str:
    out, stack, font, line = [], [], None, None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if not (t[:1].isalpha() or t in (b"'", b'"', b"T*")):
            stack.append(t)
            continue
        if t == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:])
        elif t in (b"Tj", b"'", b'"', b"TJ"):
            if t in (b"'", b'"'):
                out.append("\n")
            for s in stack:
                if s[:1] in (b"(", b"<") and s != b"<<":
                    out.append(_shown(_string(s), font))
                elif t == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", s) and float(s) < -200:
                    out.append(" ")
        elif t in (b"Td", b"TD") and len(stack) >= 2:
            out.append("\n" if float(stack[-1]) else " ")
        elif t == b"Tm" and len(stack) >= 6:
            out.append("\n" if line is not None and stack[-1] != line else " ")
            line = stack[-1]
        elif t in (b"T*", b"ET"):
            out.append("\n")
        elif t == b"Do" and stack:
            out.append(draw(stack[-1][1:]))
        stack = []
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def pdf(data: bytes, ocr: Callable[[bytes], str] | None = None) -> str:
    """Pages by blank lines, with the text of the forms that they draw. The images of a page that shows next to nothing are
    read by the OCR layer, where one is given; no pages, or one that stays blank, is refused: it may be a scan."""
    if not data.lstrip().startswith(b"%PDF"):
        raise ConversionError("not a PDF")
    if b"/Encrypt" in data:
        raise ConversionError("the PDF is encrypted")
    try:
        doc = _Document(data)
        pages = doc.pages()
        if not pages:
            raise ConversionError("the PDF has no pages that can be read")
        texts = []
        for k, p in enumerate(pages):
            m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|" + _REF + rb")", p)
            nums = re.findall(_REF, m[1]) if m and m[1] else [m[2]] if m else []
            images: list[int] = []
            text = doc.text(p, b"\n".join(doc.stream(int(n)) for n in nums), images)
            if ocr and images and sum(not c.isspace() for c in text) < THIN:
                text = "\n".join(filter(str.strip, (text, *(ocr(doc.image(n)) for n in dict.fromkeys(images)))))
            if not text.strip():
                raise ConversionError(f"page {k + 1} has no text; it may be a scanned image, which this build doesn't read")
            texts.append(text)
    except ConversionError:
        raise
    except Exception as e:  # a malformed file mustn't end the job
        raise ConversionError(f"the PDF can't be read: {type(e).__name__}") from e
    return "\n\n".join(texts) + "\n"
