"""License scan by conditional compression.

Candidate blocks are the sentences and paragraphs of a text, and windows of as many words as a template
has: where an anchor word of the template (its words of licensing, or else its longest word) occurs in a
text, all those in which it stands so near its place in the template as a match allows. A block is compressed alone and with every template of a fitting
number of words as zstandard raw dictionary. In the order of their size reductions, the templates are
confirmed by exact wording: a diff of the two word sequences lists what is missing and what was added,
and a match may have `max_differing` of the template's words missing or added at most. The words that
two texts have in common in any order bound the diff, so hopeless ones are not diffed. Of overlapping
matches the one with most words in common stays.

Templates are short notices, whole texts of the short licenses (MIT, ISC, BSD, the Apache header) and the
titles of the long ones, whose bodies are not compared. A text that has no anchor word of any template
has no candidate blocks.

Edge cases: a null or empty text has no blocks; equal ranks go to the template that comes first;
repeated rows have equal results; very long texts are searched whole; an empty table gives no rows;
other columns are ignored; without templates, or with templates without words, nothing is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

#: Usual notices of common licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0)."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
TRIGGERS = ("licen", "copyright", "permission", "redistribut", "public domain", "rights reserved", "free software", "spdx")
SENTENCE = re.compile(r"[^\n]+?(?:[.;:!?](?=\s)|\n|\Z)")
PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
WORD = re.compile(r"\w+(?:[.-]\w+)*")


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], max_differing: float = 0.25):
        self.templates = []
        # Anchor words of each template, with the places where they occur; stems: what a text must hold.
        self.anchors: dict[str, list[tuple[int, int, int]]] = {}
        self.stems: set[str] = set()
        for name, text in templates:
            listed = WORD.findall(text.lower())
            if not listed:
                continue
            data = zstandard.ZstdCompressionDict(text.encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            k = len(self.templates)
            self.templates.append((name, listed, Counter(listed), zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False)))
            for word in {w for w in listed if any(t in w for t in TRIGGERS)} or {max(listed, key=len)}:
                self.anchors.setdefault(word, []).extend((k, place, len(listed)) for place, w in enumerate(listed) if w == word)
                self.stems.add(next((t for t in TRIGGERS if t in word), word))
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.max_differing = max_differing

    def best(self, block: str) -> dict | None:
        """The template that confirms with least differing words; equal ones by their size reduction."""
        listed = WORD.findall(block.lower())
        fitting = [k for k, (_, wanted, _, _) in enumerate(self.templates) if abs(len(wanted) - len(listed)) <= self.max_differing * len(wanted)]
        if not fitting:
            return None
        raw, words, found = block.encode(), Counter(listed), None
        plain = len(self.alone.compress(raw))
        for reduction, k in sorted(((1 - len(self.templates[k][3].compress(raw)) / plain, -k) for k in fitting), reverse=True):
            match = self.confirm(-k, listed, words, reduction)
            if match and (found is None or match["differing"] < found["differing"]):
                found = match
        return found

    def confirm(self, k: int, listed: list[str], words: Counter, reduction: float | None = None) -> dict | None:
        name, wanted, bag, _ = self.templates[k]
        allowed = self.max_differing * len(wanted)
        if (bag - words).total() + (words - bag).total() > allowed:
            return None
        missing, added = [], []
        for what, a, b, c, d in SequenceMatcher(None, wanted, listed, autojunk=False).get_opcodes():
            if what != "equal":
                missing += wanted[a:b]
                added += listed[c:d]
        differing = len(missing) + len(added)
        if differing <= allowed:
            return {"license": name, "reduction": reduction, "differing": differing, "common": len(wanted) - differing, "missing": missing, "added": added}
        return None

    def windows(self, text: str) -> Iterator[dict]:
        """Confirmed windows of the templates' lengths around the anchor words of a text."""
        at = list(WORD.finditer(text))
        listed = [m.group().lower() for m in at]
        tried = set()
        for i, word in enumerate(listed):
            for k, place, n in self.anchors.get(word, ()):
                slack = int(self.max_differing * n)
                for first in range(max(0, i - place - slack), max(0, i - place + slack) + 1):
                    if (first, k) in tried or first >= len(listed):
                        continue
                    tried.add((first, k))
                    last = min(len(listed), first + n)
                    match = self.confirm(k, listed[first:last], Counter(listed[first:last]))
                    if match:
                        start, end = at[first].start(), at[last - 1].end()
                        raw = text[start:end].encode()
                        match["reduction"] = 1 - len(self.templates[k][3].compress(raw)) / len(self.alone.compress(raw))
                        yield {"start": start, "end": end} | match


def scan_text(text: str | None, matcher: Matcher) -> list[dict]:
    """Confirmed notices of a text in order, none overlapping another."""
    low = text.lower() if text else ""
    if not any(t in low for t in matcher.stems):
        return []
    found: list[dict] = []
    for pattern in (PARAGRAPH, SENTENCE):
        for m in pattern.finditer(text):
            block = m.group().strip()
            if any(t in block.lower() for t in matcher.stems):
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                best = matcher.best(block)
                if best:
                    found.append({"start": start, "end": start + len(block)} | best)
    found += matcher.windows(text)
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: -f["common"]):
        at = bisect_left(kept, f["start"], key=lambda x: x["start"])
        if (at == 0 or kept[at - 1]["end"] <= f["start"]) and (at == len(kept) or f["end"] <= kept[at]["start"]):
            kept.insert(at, f)
    return kept


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_licenses, licenses (distinct, sorted), findings array<struct<
    license, start, end, reduction, missing, added>> with code point offsets."""
    known = TEMPLATES if templates is None else templates
    finding = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])
    schema = "doc_id long, n_licenses long, licenses array<string>, findings array<struct<license:string,start:long,end:long,reduction:double,missing:array<string>,added:array<string>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known)
        for b in batches:
            found = [[{k: f[k] for k in ("license", "start", "end", "reduction", "missing", "added")} for f in scan_text(t.as_py(), matcher)] for t in b.column(1)]
            names = [sorted({f["license"] for f in x}) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(found, pa.list_(finding))], names=["doc_id", "n_licenses", "licenses", "findings"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
