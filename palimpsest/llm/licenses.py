"""License scans by conditional compression.

A text's candidate blocks start at a sentence that speaks of licensing: that sentence, its paragraph, and as much as the
longest template could take. Each block is compressed plainly and with each
template's wordings as a raw zstandard dictionary; templates are ranked by the bytes that they save. The winners are
confirmed by their exact differences in wording: words of a wording that the block lacks, and words that it adds.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import column_bytes, small, spread, table

#: Wordings of licenses by SPDX identifier: notices, and the paragraphs that identify a full text. Fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
#: The texts of short licenses as a whole, from their first words of permission on. Fixed values.
WHOLE: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
TEMPLATES = {name: (*wordings, *([WHOLE[name]] if name in WHOLE else [])) for name, wordings in TEMPLATES.items()}
#: What makes a sentence start a block; words may be parted by a line break and a comment's sign.
CUE = re.compile(rb"licen[sc]e|copyright|spdx|creative commons|redistribut|public domain|permission (?:is hereby|to use)|free software|\bCC[ -]BY|the name of the copyright|unless required by applicable".replace(b"[ -]", b"[-\\s]").replace(b" ", rb"\s+(?:[#*/;%-]+\s+)?"), re.I)
SENTENCE = re.compile(rb"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
#: A sentence that may run over single line breaks, and what parts paragraphs.
WRAPPED = re.compile(rb"(?:[^\n]|\n(?![ \t\r]*\n))+?(?:[.!?](?=\s)|(?=\n[ \t\r]*\n)|\Z)")
#: A line break within a sentence, with the sign of a comment.
BREAK = re.compile(rb"[ \t\r]*\n[\s#*/;%-]*")
PARAGRAPH, STOP = re.compile(rb"\n[ \t\r]*\n"), re.compile(rb"[.!?]\s")
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
#: zstandard level, templates that are compared word by word, least saving in bytes, share of words that a close copy may
#: differ in, words in common that a difference outweighs.
LEVEL, WINNERS, LEAST_SAVED, CLOSE, PENALTY = 9, 3, 8, 0.1, 3
#: Bytes before its cue that a block begins at most, and as many words about.
BEFORE, LEAD = 120, 40
OUT = "doc_id long, start long, length long, license string, saved int, ratio double, n_words int, n_missing int, n_extra int, confirmed boolean"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: The longest wording in bytes with half as much again: what follows can be no part of one, and a block holds no more.
BLOCK_BYTES = 3 * max(len(w) for t in TEMPLATES.values() for w in t) // 2


@cache
def compressors():
    import zstandard as z

    with_template = {}
    for name, wordings in TEMPLATES.items():
        d = z.ZstdCompressionDict("\n".join(wordings).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        with_template[name] = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)
    return z.ZstdCompressor(level=LEVEL, write_content_size=False), with_template


@cache
def wordings(name: str) -> list[list[str]]:
    return [words(w) for w in TEMPLATES[name]]


def saved(block: bytes) -> list[tuple[int, str]]:
    """Templates by the bytes that they save, most first."""
    plain, with_template = compressors()
    size = len(plain.compress(block))
    return sorted(((size - len(c.compress(block)), name) for name, c in with_template.items()), key=lambda x: (-x[0], x[1]))


def differences(block: list[str], name: str) -> tuple[int, int, int, int, int]:
    """Missing words, added words, length of the wording of a template that the block's beginning is nearest to, and the
    block's first word of it and the one after the last. The nearest has most words in common, PENALTY for each that
    differs taken off: a whole text with a word changed, rather than a paragraph of it.

    Added words count between the first and the last word that agree; what surrounds a wording is not its own.
    """
    best = None
    for w in wordings(name):
        part = block[: len(w) * 3 // 2 + LEAD]
        same = [m for m in difflib.SequenceMatcher(None, w, part, autojunk=False).get_matching_blocks() if m.size]
        hit = sum(m.size for m in same)
        added = same[-1].b + same[-1].size - same[0].b - hit if same else 0
        key = (PENALTY * (len(w) - hit + added) - hit, -len(w))
        if best is None or key < best[0]:
            best = (key, (len(w) - hit, added, len(w), same[0].b if same else 0, same[-1].b + same[-1].size if same else 0))
    return best[1]


def scan(text: bytes) -> list[tuple]:
    """start, length (bytes), license, saved, ratio, n_words, n_missing, n_extra, confirmed for each block of a text."""
    out, done = [], 0
    for cue in CUE.finditer(text):
        if cue.start() < done:
            continue
        low = max(done, cue.start() - BEFORE)
        line = max(low, text.rfind(b"\n", low, cue.start()) + 1)
        paragraph = max((m.end() for m in PARAGRAPH.finditer(text, low, cue.start())), default=low)
        best = None
        # the cue may stand on a later line of a wrapped sentence: the block from its line's and its paragraph's sentence
        for begin in dict.fromkeys(max((m.end() for m in STOP.finditer(text, x, cue.start())), default=x) for x in (line, paragraph)):
            while begin < cue.start() and text[begin] & 0xC0 == 0x80:
                begin += 1  # never within a character, or places wouldn't agree with bytes
            block = text[begin : begin + BLOCK_BYTES]
            gap = PARAGRAPH.search(text, cue.end(), begin + BLOCK_BYTES)
            first = text[begin : gap.start()] if gap else block
            notices = dict.fromkeys(max(m.end() if m else 0, cue.end()) for m in (SENTENCE.match(text, begin, begin + BLOCK_BYTES), WRAPPED.match(text, begin, begin + BLOCK_BYTES)))
            shown = block.decode("utf-8", "replace")
            places = [m.span() for m in WORD.finditer(shown)]
            spoken = [shown[i:j].lower() for i, j in places]
            # a notice is a sentence or a paragraph, a full text is several: the best of all are compared word by word
            gains = {}
            for part in dict.fromkeys((*(BREAK.sub(b" ", text[begin:n]) for n in notices), first, block)):
                for gain, name in saved(part)[:WINNERS]:
                    gains[name] = max(gain, gains.get(name, 0))
            for name, gain in gains.items():
                if gain >= LEAST_SAVED:
                    missing, added, n, i, j = differences(spoken, name)
                    row = (PENALTY * (missing + added) - (n - missing), -gain, name, missing, added, n, i, j)
                    if best is None or row < best:
                        best, span = row, (begin + len(shown[: places[i][0]].encode()), begin + len(shown[: places[j - 1][1]].encode()))
        if best is None or best[3] > best[5] // 2:
            done = cue.end()
            continue
        _, gain, name, missing, added, n, _, _ = best
        start, end = span
        out.append((start, end - start, name, -gain, -gain / (end - start), n, missing, added, missing + added <= CLOSE * n))
        done = max(end, cue.end())
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    for b in small(batches):
        rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), column_bytes(b, "text"), strict=True) if t for r in scan(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def find(docs: DataFrame) -> DataFrame:
    """One row for each licensing block of docs (doc_id, text) that comes near a template: at least half of the words of
    one of its wordings stand there, and the template saves LEAST_SAVED bytes.

    start and length are in bytes of UTF-8. n_missing and n_extra are words against the nearest wording (of n_words);
    confirmed: none, or a tenth at most. Null and empty texts have no rows; very long ones are searched whole; repeated
    rows have theirs each; other columns are ignored, whatever their names; an empty table gives none. Equal savings are
    ranked by identifier.
    """
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(_scan, OUT)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licensing blocks of all documents; see find()."""
    return find(table(spark, sf_dir, "documents"))
