import json
import os
import zipfile
import zlib
from email.message import EmailMessage

import pytest

from palimpsest.config import parse
from palimpsest.operators.vault import Vault
from palimpsest.plans import tools
from palimpsest.plans.files import clean_files, parts_of, restore_file, review
from palimpsest.plans.rpc import MISSING, NOT_READ, NOT_SERVED, NOT_TEXT, NOTHING, Roots, Server
from palimpsest.sources.formats import ConversionError, format_of, supported
from palimpsest.sources.listing import resolve
from palimpsest.sources.readers import convert
from palimpsest.sources.readers.mail import html_text
from palimpsest.sources.sinks import CollisionError
from palimpsest.streaming.landing import clean_json_stream, clean_stream

CONFIG = parse(
    'regions = ["FR"]\nallowlist = ["Rennes"]\n[[denylist]]\nterm = "Nordlicht Logistik GmbH"\n[[denylist]]\nterm = "Marie Lambert"\nkind = "person"\n'
    '[[patterns]]\nname = "order number"\nregex = "ZX-\\\\d{5}"\n'
)
PLANTED = ["marie.lambert@nordlicht.example", "07 55 21 43 65", "DE89 3704 0044 0532 0130 00", "5555 5555 5555 4444", "83015297100032", "10.20.30.40", "7 avenue Victor Hugo", "69006 Lyon", "Nordlicht Logistik GmbH", "Marie Lambert", "ZX-40917"]
BODY = "\n".join(f"Line {i}: {p}." for i, p in enumerate(PLANTED)) + "\nRennes stays.\n"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def esc(s):
    return s.replace("&", "&amp;").replace("<", "&lt;")


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return str(path)


def docx(path, lines=BODY.splitlines(), header=""):
    runs = "".join(f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>{esc(x[:7])}</w:t></w:r><w:r><w:t>{esc(x[7:])}</w:t></w:r></w:p>" for x in lines)
    return archive(path, {"word/document.xml": f"<w:document {W}><w:body>{runs}</w:body></w:document>", "word/Header1.XML": f"<w:hdr {W}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>", "word/theme/t.xml": "<x/>"})


def odt(path, inner):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:draw="urn:d" xmlns:svg="urn:s"'
    return archive(path, {"content.xml": f"<office:document-content {ns}><office:body>{inner}</office:body></office:document-content>"})


def xlsx(path, sheets):
    parts = {"xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = "<sst><si><t>Marie Lambert</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>"
    for i, cells in enumerate(sheets.values()):
        parts[f"xl/worksheets/s{i}.xml"] = f"<worksheet><sheetData>{cells}</sheetData></worksheet>"
    return archive(path, parts)


def pdf(path, pages, flate=True):
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    for i, lines in enumerate(pages):
        body = b"BT /F1 12 Tf 72 700 Td " + b" ".join(b"(" + x.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td" for x in lines) + b" ET" if lines else b""
        data = zlib.compress(body) if flate else body
        objs[4 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i)
        objs[5 + 2 * i] = b"<< /Length %d %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" if flate else b"") + data + b"\nendstream"
    path.write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objs.items()) + b"trailer << /Root 1 0 R >>\n%%EOF")
    return str(path)


def eml(path):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "Marie Lambert <marie.lambert@nordlicht.example>", "a@b.example, c@d.example", "Order ZX-40917", "Mon, 3 Mar 2025 10:00:00 +0100"
    m.set_content(BODY)
    m.add_alternative("<div>5555 5555 5555 4444</div><div>07 55 21 43 65</div><a href='mailto:x@y.example'>mail</a>", subtype="html")
    m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="scan.pdf")
    inner = EmailMessage()
    inner["Subject"] = "Inner"
    inner.set_content("inside 10.20.30.40\n")
    m.add_attachment(inner)
    path.write_bytes(b"\xef\xbb\xbf" + m.as_bytes())
    return str(path)


def text_of(path):
    with open(path, "rb") as f:
        return "".join(t for _, _, t in convert(str(path), f.read()))


def test_conversions_keep_every_planted_value(tmp_path):
    paragraphs = "".join(f'<text:p xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">{esc(x)}</text:p>' for x in BODY.splitlines())
    for path in (docx(tmp_path / "a.docx"), odt(tmp_path / "a.odt", paragraphs), pdf(tmp_path / "a.pdf", [BODY.splitlines()]), eml(tmp_path / "a.eml")):
        text = text_of(path)
        assert all(p in text for p in PLANTED), path


def test_office_readers(tmp_path):
    assert text_of(docx(tmp_path / "h.docx", ["A &amp; B"], "Head")).splitlines()[0] == "Head"
    slides = {f"ppt/slides/slide{n}.xml": f'<s xmlns:a="urn:a"><a:p><a:r><a:t>S{n}</a:t></a:r></a:p></s>' for n in (10, 2, 1)} | {"ppt/notesSlides/notesSlide1.xml": '<s xmlns:a="urn:a"><a:p><a:r><a:t>N</a:t></a:r></a:p></s>', "ppt/comments/comment1.xml": "<c><text>C</text></c>", "ppt/slideLayouts/x.xml": '<p xmlns:a="urn:a"><a:t>no</a:t></p>'}
    assert text_of(archive(tmp_path / "s.pptx", slides)) == "S1\nS2\nS10\nN\nC\n"
    inner = '<text:p>Lam<text:span>bert</text:span> &amp; Fils<text:s text:c="2"/>x<office:annotation><dc:creator>Marie</dc:creator><text:p>note</text:p></office:annotation> end</text:p><text:p><draw:frame><svg:title>alt</svg:title></draw:frame>tail</text:p>'
    assert text_of(odt(tmp_path / "o.odt", inner)) == "Lambert & Fils  x\nMarie\nnote\n end\nalt\ntail\n"
    book = xlsx(tmp_path / "b.xlsx", {"One": '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>83015297100032</v></c></row><row r="2"/><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c></row>', "Empty": "", "Two": '<row r="1"><c r="A1"><v>1.5</v></c><c r="B1" t="b"><v>1</v></c><c r="C1" t="s"><v>1</v></c></row>'})
    with open(book, "rb") as f:
        assert convert(book, f.read()) == [(0, "One", "Marie Lambert\t\t83015297100032\n\tx\t\n"), (2, "Two", "1.5\ttrue\tab\n")]


def test_what_is_not_read_in_full_is_refused(tmp_path):
    bad = [docx(tmp_path / "e.docx", []), pdf(tmp_path / "e.pdf", [["text here and more"], []]), archive(tmp_path / "n.docx", {"x": ""}), archive(tmp_path / "u.docx", {"word/document.xml": f"<!DOCTYPE d [<!ENTITY e 'x'>]><w:document {W}><w:t>&e;</w:t></w:document>"}), xlsx(tmp_path / "e.xlsx", {"A": ""})]
    for name, data in (("l.txt", b"caf\xe9"), ("i.png", b"x"), ("z.zip", b"x"), ("p.pdf", b"nope"), ("d.docx", b"nope"), ("e.eml", b"")):
        (tmp_path / name).write_bytes(data)
        bad.append(str(tmp_path / name))
    for path in bad:
        with pytest.raises(ConversionError):
            text_of(path)


def test_pdf_forms_thin_pages_and_large_streams(tmp_path, monkeypatch):
    from palimpsest.sources.readers import pdf as reader

    def page(content, extra):
        objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [4 0 R] >>", 3: b"<< /Type /Font /Subtype /Type1 >>", 5: b"<< /Length 1 >>\nstream\n" + content + b"\nendstream"}
        objs[4] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Fm 6 0 R /Im 8 0 R >> >> /Contents 5 0 R >>"
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in (objs | extra).items()) + b"trailer << /Root 1 0 R >>"

    packed = zlib.compress(b"BT /F1 9 Tf (within a form) Tj ET /In Do")
    forms = {6: b"<< /Subtype /Form /Filter /FlateDecode /Resources << /Font << /F1 3 0 R >> /XObject << /In 7 0 R >> >> >>\nstream\n" + packed + b"\nendstream", 7: b"<< /Subtype /Form >>\nstream\nBT /F1 9 Tf (and a form in that) Tj ET\nendstream", 8: b"<< /Subtype /Image /Filter /DCTDecode >>\nstream\nJPEG\nendstream"}
    text = reader.pdf(page(b"BT /F1 9 Tf (on the page) Tj ET /Fm Do", forms))
    assert text.split("\n") == ["on the page", "within a form", "and a form in that", ""]
    scan = page(b"/Im Do", forms)
    with pytest.raises(ConversionError):
        reader.pdf(scan)
    assert reader.pdf(scan, lambda image: f"read {image.decode()}") == "read JPEG\n"
    loop = {6: b"<< /Subtype /Form /Resources << /XObject << /Fm 6 0 R >> >> >>\nstream\n/Fm Do\nendstream"}
    monkeypatch.setattr(reader, "MOST", 20)
    for bad in (page(b"/Fm Do", loop), page(b"/Fm Do", forms)):
        with pytest.raises(ConversionError):
            reader.pdf(bad)


def test_mail_and_html(tmp_path):
    text = text_of(eml(tmp_path / "m.eml"))
    assert text.startswith("Date: Mon, 3 Mar 2025 10:00:00 +0100\nFrom: Marie Lambert <marie.lambert@nordlicht.example>\nTo: a@b.example, c@d.example\nSubject: Order ZX-40917\nAttachment: scan.pdf (application/pdf)\n")
    assert "5555 5555 5555 4444\n" in text and "x@y.example" in text and "Forwarded message:\n\nSubject: Inner\n\ninside 10.20.30.40" in text
    assert html_text("<p>Marie <b>Lam</b>bert<br>x</p><div>y</div><span>78</span><span>Merci</span>") == "Marie Lambert\nx\n\ny\n\n78\nMerci"
    assert "kept 09" in html_text("<head><style>a{}</style><body>" + "kept 09 " * 30)


def test_listing(tmp_path):
    for n in ("b.txt", "_a.txt", ".h.txt", "x.bin", "done.clean.md", "sub/c.csv", ".hid/d.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    os.symlink(tmp_path / "b.txt", tmp_path / "l.txt")
    names = lambda r: [os.path.relpath(i.path, tmp_path) for i in r[0]]
    assert names(resolve([str(tmp_path)])) == ["_a.txt", "b.txt"] and resolve([str(tmp_path)])[1] == 1
    assert names(resolve([str(tmp_path)], True)) == ["_a.txt", "b.txt", "sub/c.csv"]
    assert names(resolve([str(tmp_path / ".h.txt"), str(tmp_path / "x.bin")])) == [".h.txt", "x.bin"]
    assert format_of("A.MarkDown") == "text" and format_of("noext") is None and "png" not in supported()


def test_files_are_cleaned_without_leaks_and_restored(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "deep").mkdir(parents=True)
    (src / "Marie Lambert.txt").write_text(BODY)
    (src / "deep" / "t.csv").write_text("name,mail\nMarie Lambert,marie.lambert@nordlicht.example\n")
    docx(src / "c.docx")
    xlsx(src / "b.xlsx", {"Marie Lambert": '<row r="1"><c r="A1" t="s"><v>0</v></c></row>', "a/b": '<row r="1"><c r="A1"><v>1</v></c></row>', "A_B": '<row r="1"><c r="A1"><v>2</v></c></row>'})
    store = Vault(spark, tmp_path / "v", tmp_path / "k")
    done, skipped = clean_files(spark, [str(src)], CONFIG, store, str(out), recursive=True)
    files = {os.path.relpath(r.destination, out): open(r.destination).read() for r in done.collect()}
    assert set(files) == {"PERSON_1.clean.md", "deep/t.clean.csv", "c.clean.md", "b.PERSON_1.clean.tsv", "b.a_b.clean.tsv", "b.A_B_2.clean.tsv"} and skipped == 0
    for name, text in files.items():
        assert not any(p in text for p in PLANTED), name
    assert "Rennes stays." in files["c.clean.md"] and files["deep/t.clean.csv"].startswith("name,mail\n[[PERSON_1]],[[EMAIL_1]]")
    again = {r.destination: open(r.destination).read() for r in clean_files(spark, [str(src)], CONFIG, store, str(out), recursive=True)[0].collect()}
    assert {os.path.relpath(k, out): v for k, v in again.items()} == files
    text, known, unknown = restore_file(spark, str(out / "PERSON_1.clean.md"), store)
    assert text == BODY and unknown == 0 and (out / "PERSON_1.clean.md").read_text() == BODY and known >= len(PLANTED)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "c.docx").write_bytes((src / "c.docx").read_bytes())
    with pytest.raises(CollisionError):
        clean_files(spark, [str(src / "c.docx"), str(tmp_path / "x" / "c.docx")], CONFIG, store, str(out))


def test_review_keeps_rejected_values_out_of_the_vault(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Call 07 55 21 43 65 now\nand a@b.example\n")
    store = Vault(spark, tmp_path / "v", tmp_path / "k")
    found = review(parts_of(spark, [str(tmp_path / "a.txt")])[0], CONFIG)
    assert sorted(r.context for r in found.collect()) == ["Call 07 55 21 43 65 now", "and a@b.example"]
    edited = found.withColumn("accepted", found["tag"] != "PHONE")
    out = clean_files(spark, [str(tmp_path / "a.txt")], CONFIG, store, str(tmp_path / "o"), decisions=edited)[0].first()
    assert open(out.destination).read() == "Call 07 55 21 43 65 now\nand [[EMAIL_1]]\n"
    assert [r.tag for r in store.entries().collect()] == ["EMAIL"]


def test_tool_replies(spark, tmp_path):
    store = Vault(spark, tmp_path / "v", tmp_path / "k")
    given = {"tool_result": {"a@b.example": ["mail a@b.example", 1, None, True], "n": {"x": "10.20.30.40"}}}
    after = tools.reply_after(spark, json.dumps(given), CONFIG, store)
    assert '"a@b.example": ["mail [[EMAIL_1]]", 1, null, true]' in after and "[[IP_1]]" in after
    assert tools.reply_after(spark, '{"tool_result": null}', CONFIG, store) is None and tools.WITHHELD in tools.reply_after(spark, "nope", CONFIG, store)
    before = tools.reply_before(spark, json.dumps({"tool_input": {"q": "to [[EMAIL_1]]"}}), store)
    assert '"q": "to a@b.example"' in before and tools.reply_before(spark, '{"tool_input": {"q": "x"}}', store) is None and tools.REFUSED in tools.reply_before(spark, "[", store)


def test_rpc(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_text("a@b.example\n")
    (tmp_path / "secret.txt").write_text("x")
    (root / "bad.docx").write_text("x")
    s = Server(spark, CONFIG, Vault(spark, tmp_path / "v", tmp_path / "k"), Roots([str(root)]))
    ask = lambda id, method, **p: json.dumps({"jsonrpc": "2.0", "id": id, "method": method, "params": p})
    lines = [ask(1, "initialize", protocolVersion="2025-06-18"), '{"method": "notifications/initialized"}', ask(2, "tools/list"), ask(3, "tools/call", name="clean", arguments={"path": str(root / "a.txt")}), "not json", "[]", ask(4, "tools/call", name="map_list"), ask(5, "nope"), ask(6, "ping")]
    lines += [ask(k, "tools/call", name="clean", arguments={"path": str(root / p)}) for k, p in ((7, "../secret.txt"), (8, "missing"), (9, "bad.docx"))]
    got = list(map(json.loads, s.serve(lines)))
    assert got[0]["result"]["protocolVersion"] == "2025-06-18" and [t["name"] for t in got[1]["result"]["tools"]] == ["clean", "map_list"]
    say = lambda g: g["result"]["content"][0]["text"]
    assert say(got[2]) == "[[EMAIL_1]]\n" and got[3]["error"]["code"] == -32700 and got[4]["error"]["code"] == -32600
    assert say(got[5]) == "[[EMAIL_1]]" and got[6]["error"]["code"] == -32601 and got[7]["result"] == {}
    assert [say(g) for g in got[8:]] == [NOT_SERVED, NOT_SERVED, NOT_READ.format("docx")] and all(g["result"]["isError"] for g in got[8:])
    assert "id" not in got[3] and "id" not in got[4]
    (root / "pack.tar.gz").write_bytes(b"x")
    (root / "latin.txt").write_bytes(b"na\xefve")
    free = Server(spark, CONFIG, Vault(spark, tmp_path / "v2", tmp_path / "k"), Roots(None))
    ask2 = lambda name, **a: json.loads(free.handle(ask(1, "tools/call", name=name, arguments=a)))["result"]
    empty, pack, latin, gone, odd = ask2("map_list"), ask2("clean", path=str(root / "pack.tar.gz")), ask2("clean", path=str(root / "latin.txt")), ask2("clean", path=str(root / "gone.txt")), ask2("restore", path="x")
    assert not empty["isError"] and empty["content"][0]["text"] == NOTHING and "docx" in pack["content"][0]["text"]
    assert latin["content"][0]["text"] == NOT_TEXT and gone["content"][0]["text"] == MISSING and all(r["isError"] for r in (pack, latin, gone, odd))


def test_streams(spark, tmp_path):
    land, out, store = tmp_path / "land", tmp_path / "out", Vault(spark, tmp_path / "v", tmp_path / "k")
    spark.createDataFrame([(1, "a@b.example"), (2, "c@d.example a@b.example")], "doc_id long, text string").coalesce(1).write.parquet(str(land))
    src = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(land))
    clean_stream(src(), CONFIG, store, str(out), str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([(3, "c@d.example")], "doc_id long, text string").write.mode("append").parquet(str(land))
    clean_stream(src(), CONFIG, store, str(out), str(tmp_path / "c")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(out)).orderBy("doc_id").collect()] == ["[[EMAIL_1]]", "[[EMAIL_2]] [[EMAIL_1]]", "[[EMAIL_2]]"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"k": "c@d.example"}\nnope\n{"k": "c@d.example"}\n')
    clean_json_stream(spark, str(tmp_path / "j"), CONFIG, store, str(tmp_path / "jo"), str(tmp_path / "jc")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "jo")).collect()
    assert sorted(str(r.payload) for r in got) == ["None", '{"k": "[[EMAIL_2]]"}', '{"k": "[[EMAIL_2]]"}'] and [r.error for r in got if r.error] == ["not valid JSON"]


def test_mail_headers_are_parsed_once(monkeypatch):
    """The library parses a header again each time its value is asked for."""
    from email import headerregistry

    from palimpsest.sources.readers import mail

    parsed, parse = [], headerregistry.ContentTypeHeader.parse.__func__
    monkeypatch.setattr(headerregistry.ContentTypeHeader, "parse", classmethod(lambda cls, value, kwds: (parsed.append(value), parse(cls, value, kwds))[1]))
    long = "x" * 1_000
    for k in range(3):
        m = f'From: A <a{k}@b.example>\r\nContent-Type: multipart/mixed; boundary="once"\r\n\r\n--once\r\nContent-Type: text/plain; odd=once\r\n\r\nhi {k}\r\n--once\r\nContent-Type: a/{long}\r\n\r\n-\r\n--once--\r\n'
        assert mail.eml(m.encode()) == f"From: A <a{k}@b.example>\nAttachment: unnamed (a/{long})\n\nhi {k}\n"
    assert len([v for v in parsed if len(v) <= 1_000]) == 2
