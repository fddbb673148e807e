"""License scan by canonical digests.

A text is brought to a canonical form (lower case, copyright lines out, equivalent spellings merged, all punctuation and white
space to single spaces) and its SHA-256 is hash-joined to the digests of known texts, brought to the same form. Units are
the whole text and, where a document holds any of the marks that every known text holds, each of its lines and paragraphs.
All of it is DataFrame code.

Defined cases: a null text is empty and matches nothing; an empty canonical form matches nothing; repeated rows get equal
rows; a null ``doc_id`` is an id like any other; extra columns are ignored; an empty table gives an empty result; a table of known texts may be passed instead of the built-in one.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, whole_text

#: Lines that only state a copyright.
COPYRIGHT = r"(?m)^[^0-9A-Za-z(©\n]*(?:copyright *(?:\(c\)|©|[0-9<\[{])|\(c\) *[0-9]|©|all rights reserved)[^\n]*$"
#: Everything but letters and digits.
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, applied in this order to the text without punctuation.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("utilis", "utiliz"), ("initialis", "initializ"), ("recognis", "recogniz"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("wilful", "willful"), ("whilst", "while"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright holder", "copyright owner"), ("merchantibility", "merchantability"), ("centre", "center"), ("https", "http"),
]
#: Every known text holds one of these; checked when the digests are made.
MARKS = r"(?i)licen[cs]|permission|redistribut|public domain|warrant"
#: Rows up to which the table of known digests is broadcast.
BROADCAST_ROWS = 100_000

_PERMISSIVE_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known texts (SPDX id, text). Copyright lines are left out, as the canonical form does.
KNOWN = [
    ("MIT", f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_PERMISSIVE_END}"""),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_PERMISSIVE_END}"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *[(i, f"SPDX-License-Identifier: {i}") for i in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "0BSD", "BSL-1.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "Unlicense")],
]

#: Title lines that files put above a known text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License"],
    "Unlicense": ["The Unlicense", "Unlicense", "This is the Unlicense"],
}
#: Whole license texts, one file each, named by SPDX id.
TEXTS = Path(__file__).with_name("license_texts")
#: What follows the terms of a whole license and is often left out.
APPENDIX = re.compile(r"\n[ \t]*(?:END OF TERMS AND CONDITIONS|Exhibit A - )")
#: Lists by number and lists by bullet.
NUMBER = re.compile(r"(?m)^[0-9]\. ")


def known_texts() -> list[tuple[str, str]]:
    """``KNOWN`` and the whole texts of ``TEXTS``, with and without titles, list numbers, appendices and marks of their end."""
    found = list(KNOWN)
    for name, text in KNOWN:
        if name in TITLES and len(text) > 200:
            bodies = [text, NUMBER.sub("", text)] if NUMBER.search(text) else [text]
            found += [(name, body) for body in bodies] + [(name, f"{title}\n{body}") for body in bodies for title in TITLES[name]]
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        bodies = [text]
        if end := APPENDIX.search(text):
            bodies += [text[: end.start()]] + ([text[: text.index("\n", end.start() + 1)]] if "END OF" in end[0] else [])
        found += [(name, body) for body in bodies] + [(name, f"{title}\n{body}") for body in bodies for title in TITLES.get(name, [])]
    return found


def canonical(text: Column) -> Column:
    """The canonical form; the empty string if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), PUNCTUATION, " "))
    for old, new in SPELLINGS:
        bare = F.replace(bare, F.lit(old), F.lit(new))
    return bare


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known texts (license, text); one row per digest."""
    known = known if known is not None else spark.createDataFrame(known_texts(), "license string, text string")
    if not known.filter(~F.col("text").rlike(MARKS)).isEmpty():
        raise ValueError("a known text holds none of the marks")
    return known.filter(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, whole_license, licenses, n_units) of every document row.

    ``text_sha256`` is the canonical digest of the whole text, ``whole_license`` what it equals, ``licenses`` the sorted
    distinct licenses of all matching units, ``n_units`` how many lines and paragraphs match.
    """
    table = known_digests(docs.sparkSession, known)
    table = F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    text = whole_text()
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[\x20\t]*\n"), lambda p: p.contains("\n"))
    units = F.filter(F.concat(lines, paragraphs), lambda u: u.rlike(MARKS))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), digest(text).alias("text_sha256"), F.when(text.rlike(MARKS), F.transform(units, digest)).alias("units"))
    rows = cut(rows, "licenses")
    found = rows.dropDuplicates(["id", "row"]).select("id", "row", F.explode("units").alias("digest")).join(table, "digest")
    found = found.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("license")).alias("by_unit"), F.count("*").alias("n_units"))
    whole = rows.join(table.select(F.col("digest").alias("text_sha256"), F.col("license").alias("whole_license")), "text_sha256", "left")
    both = whole.join(found, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    names = F.array_distinct(F.concat(F.coalesce("by_unit", F.array().cast("array<string>")), F.filter(F.array("whole_license"), lambda x: x.isNotNull())))
    return both.select(F.col("id").alias(id_col), "text_sha256", "whole_license", F.array_join(F.array_sort(names), ",").alias("licenses"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))
