"""Messages: the headers people write, every body, forwarded messages, and the names of attachments."""

from __future__ import annotations

import email
import html
import re
from email import policy
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage
from email.utils import getaddresses, parsedate_to_datetime
from functools import lru_cache
from html.parser import HTMLParser

from palimpsest.sources.formats import ConversionError

#: Tags whose text runs on with the text beside them.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Levels of forwarding that are followed.
DEPTH = 8
#: Elements whose text isn't shown, and schemes of links that hold an address or a number.
HIDDEN, ADDRESS_SCHEMES = ("head", "script", "style"), ("mailto", "tel")
ADDRESSED = ("From", "Reply-To", "To", "Cc", "Bcc")

#: Headers that a worker remembers parsed, and up to how many characters.
REMEMBERED, SHORT = 2_048, 1_000
#: Programs and styles as a whole, closed or not.
SCRIPTS = re.compile(r"<(script|style)\b(?:(?!</\1\b).)*(?:</\1\b[^>]*>)?", re.I | re.S)
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


class _Page(HTMLParser):
    """Collects the text of a page, piece by piece, as tags go by.

    Every tag that isn't known to run on starts a line. So does a tag that follows at once on the end of another one with
    text in it: two cells or labels side by side are two things, though no space parts them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        #: Elements whose text isn't shown that are open, and where in `pieces` each began.
        self.hidden: list[tuple[str, int]] = []
        #: Whether the last thing seen was text that ended visibly, and whether a tag has closed since.
        self.touching = self.closed = False

    def _tag(self, name: str) -> None:
        if self.closed:
            self.pieces.append("\n")
        self.closed = False
        if name != "br" and name not in INLINE and ":" not in name:
            self.pieces.append("\n")

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tag(name)
        self.touching = False
        if name in HIDDEN:
            self.hidden.append((name, len(self.pieces)))
        if name == "br":
            self.pieces.append("\n")
        elif name == "a":
            scheme, _, target = (dict(attrs).get("href") or "").strip().partition(":")
            if scheme.lower() in ADDRESS_SCHEMES:
                self.pieces.append(f" {target} ")

    def handle_endtag(self, name: str) -> None:
        self._tag(name)
        self.closed, self.touching = self.touching, False
        if (at := next((k for k, (n, _) in enumerate(self.hidden) if n == name), None)) is not None:
            del self.pieces[self.hidden[at][1] :], self.hidden[at:]

    def handle_data(self, data: str) -> None:
        self.pieces.append(re.sub(r"\s+", " ", data))
        self.closed, self.touching = False, bool(data) and not data[-1].isspace()

    def text(self) -> str:
        """What was shown; elements left open can't hide what follows them."""
        lines = [" ".join(line.split()) for line in "".join(self.pieces).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _seen(text: str) -> int:
    return sum(not c.isspace() for c in text)


def _bare(markup: str) -> str:
    """Whatever stands between tags, one line each: for markup so broken that a parser loses most of it."""
    outside, depth = [], 0
    for piece in re.split("([<>])", markup):
        if piece in "<>":
            depth = int(piece == "<")
        elif not depth:
            outside.append(" ".join(html.unescape(piece).split()))
    return "\n".join(filter(None, outside))


def html_text(markup: str) -> str:
    """The text of a page. Link targets of addresses and numbers come beside their links, and blocks start new lines.

    If less than half of what stands between tags came through, all of that is the text instead.
    """
    page = _Page()
    page.feed(markup)
    page.close()
    text, bare = page.text(), _bare(SCRIPTS.sub(" ", markup))
    return text if _seen(text) * 2 >= _seen(bare) else bare


class _Headers(HeaderRegistry):
    """Parsed headers, which nothing changes: the library parses one again each time it is asked for, and makes a class for it."""

    def __init__(self):
        super().__init__()
        self._class = lru_cache(REMEMBERED)(super().__getitem__)
        self._short = lru_cache(REMEMBERED)(super().__call__)

    def __getitem__(self, name: str) -> type:
        return self._class(name)

    def __call__(self, name: str, value: str) -> str:
        return (self._short if len(value) <= SHORT else super().__call__)(name, value)


_POLICY = policy.default.clone(header_factory=_Headers())


def printable(value: str) -> str:
    return _CONTROL.sub(" ", value).strip()


def _headers(m: EmailMessage) -> list[str]:
    out = []
    for raw in m.get_all("Date", []):
        try:
            out.append(f"Date: {parsedate_to_datetime(str(raw)).strftime('%a, %-d %b %Y %H:%M:%S %z')}")
        except (TypeError, ValueError):
            continue
    for name in ADDRESSED:
        for value in m.get_all(name, []):
            pairs = [(a.display_name, a.addr_spec) for a in value.addresses] if hasattr(value, "addresses") else getaddresses([str(value)])
            each = [f"{printable(n)} <{printable(a)}>" if n and a else printable(n or a) for n, a in pairs]
            if each := [e for e in each if e and e != "<>"]:
                out.append(f"{name}: {', '.join(each)}")
    out += [f"Subject: {printable(str(s))}" for s in m.get_all("Subject", []) if printable(str(s))]
    return out


def _leaves(m: EmailMessage):
    """Parts in order; those of forwarded messages aren't a message's own."""
    if m.get_content_type() == "message/rfc822" or not m.is_multipart():
        yield m
    else:
        for p in m.iter_parts():
            yield from _leaves(p)


def _text(p: EmailMessage) -> str:
    raw = p.get_payload(decode=True) or b""
    try:
        return raw.decode(p.get_content_charset("utf-8"))
    except (LookupError, UnicodeDecodeError):
        if p.get_content_charset() is None:
            return raw.decode("latin-1")
        raise ConversionError(f"a body part ({p.get_content_type()}) can't be decoded, so the message would be read with less text than it holds") from None


def _render(m: EmailMessage, depth: int) -> str:
    lines = "".join(f"{h}\n" for h in _headers(m))
    parts = list(_leaves(m))
    carried = lambda p: (p.get_content_disposition() or "") == "attachment"
    bodies = [p for p in parts if p.get_content_maintype() == "text" and p.get_content_subtype() in ("plain", "html") and not carried(p)]
    nested = [p for p in parts if p.get_content_type() == "message/rfc822"]
    for p in parts:
        if not any(p is b for b in bodies + nested):
            name = p.get_filename()
            lines += f"Attachment: {printable(name) if name else 'unnamed'} ({printable(p.get_content_type())})\n"

    def block(text: str) -> str:
        return (("\n" if lines else "") + text.rstrip() + "\n") if text.strip() else ""

    for p in bodies:
        text = _text(p).replace("\r\n", "\n")
        lines += block(html_text(text) if p.get_content_subtype() == "html" else text)
    for p in nested:
        if depth >= DEPTH:
            lines += block("Forwarded message: not read, more than eight levels of forwarding")
            continue
        inner = p.get_payload()
        lines += block("Forwarded message:")
        lines += block(_render(inner[0] if isinstance(inner, list) else inner, depth + 1))
    return lines


def eml(data: bytes) -> str:
    out = _render(email.message_from_bytes(data.removeprefix(b"\xef\xbb\xbf"), policy=_POLICY), 0)
    if not out.strip():
        raise ConversionError("the message contains no text to read")
    return out
