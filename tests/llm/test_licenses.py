import re
import textwrap

import zstandard

from palimpsest.llm.licenses import LEVEL, TEMPLATES, WHOLE, find, op6_licenses, saved, scan, words

DOCS = "doc_id long, text string, license string"


def test_every_wording_is_its_template():
    for name, wordings in TEMPLATES.items():
        for w in wordings:
            text = f"Some prose before it. {w}\nAnd prose after it, of another kind.".encode()
            got = [r for r in scan(text) if r[8]]
            assert any(r[2] == name and r[6] == r[7] == 0 for r in got), (name, w, scan(text))
            start = next(r[0] for r in got if r[2] == name)
            assert text[start:].startswith(w[:12].encode())


def test_differences_are_counted_and_strangers_left_alone():
    (r,) = scan(b"Licensed under the strict Apache License, Version 2.0.")
    assert r[2] == "Apache-2.0" and r[6:9] == (0, 1, False)
    (r,) = scan(b"Licensed under CC BY-NC 4.0.")
    assert r[2] == "CC-BY-NC-4.0" and r[8]
    assert not [r for r in scan(b"His driving license was lost. Copyright law is dull.") if r[8]]
    assert saved(b"Released under the MIT License.")[0][1] == "MIT"


def test_whole_texts_are_compared_to_their_end():
    for name, body in WHOLE.items():
        text = f"Intro, as ever.\n\nCopyright (c) 2031 Eva Sandmann\n\n{body}\n\nUnrelated prose follows here.".encode()
        rows = scan(text)
        (r,) = [r for r in rows if r[2] == name and r[5] == len(words(body))]
        assert r[6:9] == (0, 0, True) and text[r[0] : r[0] + r[1]].decode().strip('"') == body.rstrip('.>/"'), name
        last = body.split()[-4]
        (r,) = [r for r in scan(text.replace(last.encode(), b"CHANGED")) if r[2] == name and r[5] == len(words(body))]
        assert r[6] >= 1 and r[8], name


def test_places_are_those_of_bytes_wherever_a_block_begins():
    for pad in range(12):
        text = ("é" * 70 + "x" * pad + "ü" * 40 + " licensed under the MIT License for all").encode()
        (r,) = scan(text)
        assert text[r[0] : r[0] + r[1]] == b"licensed under the MIT License" and r[2] == "MIT", pad


def test_savings_are_those_of_plain_compression():
    block = b"Licensed under the GNU Affero General Public License, version 3, as it were."
    size = lambda **how: len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, **how).compress(block))
    raw = lambda t: zstandard.ZstdCompressionDict("\n".join(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    want = sorted(((size() - size(dict_data=raw(t)), n) for n, t in TEMPLATES.items()), key=lambda x: (-x[0], x[1]))
    assert saved(block) == want and want[0][1] == "AGPL-3.0"


def test_whole_table_against_plain_search(spark):
    d = "/root/testdata/sf0.01"
    got = op6_licenses(spark, d).collect()
    exact = {(r.doc_id, r.license) for r in got if r.confirmed and r.n_missing == r.n_extra == 0}
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+(?:[.\-'][^\W_]+)*", t.lower())) + " "
    short = {n: [norm(w) for w in ws] for n, ws in TEMPLATES.items()}
    want = {(r.doc_id, n) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for n, ws in short.items() if any(w in norm(r.text) for w in ws)}
    assert want and exact == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License.", "x"), (1, None, "x"), (2, "", "x"), (3, "Released under the MIT License. " * 400, "x"), (4, "é " * 90_000 + "SPDX-License-Identifier: MIT", "x")], DOCS)
    got = find(df).collect()
    assert sum(r.doc_id == 3 for r in got) == 400 and {r.license for r in got} == {"MIT"}
    last = next(r for r in got if r.doc_id == 4)
    assert last.start == 3 * 90_000 and last.confirmed
    assert find(df.limit(0)).count() == 0


def test_every_wording_is_found_wrapped_at_any_width():
    for name, wordings in TEMPLATES.items():
        for w in wordings:
            for width in (20, 33, 50, 60, 70, 80):
                for before, lead in (("Some prose before it.\n", ""), ("A heading\n\n", " * "), ("", "# ")):
                    lines = [lead + x for x in textwrap.wrap(w, width, break_long_words=False, break_on_hyphens=False)]
                    text = (before + "\n".join(lines) + "\n\nAnd prose after it.").encode()
                    got = [r for r in scan(text) if r[8] and r[2] == name and r[6] == r[7] == 0]
                    assert any(text[r[0] :].startswith(w[:5].encode()) for r in got), (name, text, scan(text))
