"""License scans by canonical digest lookup, in DataFrame operations alone.

A text is brought to a canonical form (A-Z lower-cased, copyright lines dropped, punctuation and white space
reduced to single spaces, equivalent spellings made equal) and its digest is hash-joined to the digests of known license
texts, brought to the same form by the same expression.

The closing line of a text, where declarations stand, is looked up in the same way.

Defined results: a null text counts as empty; a text or line with an empty canonical form matches nothing; rows that repeat get the same
result each; the whole of every text is digested, whatever its length; an empty table has an empty result; of the table's columns only
doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfield.llm.common import ascii_lower, read

# Spellings that license comparison treats as the same word.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("licence", "license"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("per cent", "percent"), ("recognise", "recognize"), ("sub license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

# Public license texts and declarations.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = _BSD.replace("\n\nTHIS SOFTWARE", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE""")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_3),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("GPL-2.0-or-later", _GPL.format(n=2)),
    ("GPL-3.0-or-later", _GPL.format(n=3)),
    ("LGPL-2.1-or-later", _GPL.format(n=2.1).replace("GNU General", "GNU Lesser General")),
    ("LGPL-3.0-or-later", _GPL.format(n=3).replace("GNU General", "GNU Lesser General")),
    ("MPL-2.0", _MPL),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

# Words after "copyright" with which a sentence goes on.
SENTENCE = "(notices?|holders?|owners?|licen[sc]es?|licensors?|statements?|interests?|laws?|and|or)"
#: A line that only states a copyright: a sign, a year or a name follows the word. Sentences wrapped before the word go on otherwise.
COPYRIGHT_LINE = (
    r"(?md)^[^a-z0-9\n]*(\(c\)([^a-z\n][^\n]*)?"
    rf"|copyright(?=[^\n]*[^\x00-/:-@\[-`{{-\x7f])[^a-z\n](?![^a-z0-9(\n]*{SENTENCE}\b(?![ \t]*:))[^\n]*)$"
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    c = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    c = F.regexp_replace(F.regexp_replace(c, "https", "http"), r"[\x00-/:-@\[-`{-\x7f]+", " ")
    # spellings are whole words: each word is set between spaces of its own
    c = F.concat(F.lit(" "), F.replace(F.trim(c), F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in spellings():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def spellings() -> list[tuple[str, str]]:
    """The equivalent spellings and their forms with an s, each word between two spaces."""
    both = [(a + end, b + end) for a, b in SPELLINGS for end in ("", "s")]
    return [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in both]


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, lower-case hex."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): one row for each known canonical form."""
    rows = spark.createDataFrame([*known], "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def known_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(digest, license) of a folder of whole license texts, each a UTF-8 file named after its license, with or without .txt.

    A path or pattern that Spark's readers open; texts stay on the executors.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    name = F.regexp_replace(F.url_decode("name"), r"\.txt$", "")
    return files.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min(name).alias("license"))


def closing_line(text: Column) -> Column:
    """The last line of a text that holds more than spaces, tabs and line ends."""
    return F.substring_index(F.substring_index(F.rtrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), "\n", -1), "\r", -1)


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (null where the text as a whole is no known one), notice (the license that the closing line alone declares).

    known: (digest, license) with one row a digest. A table of any size works: Spark broadcasts it only below its threshold.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    rows = docs.select("doc_id", canonical(F.col("text")).alias("form"), canonical(closing_line(F.col("text"))).alias("line"))
    found = lambda c: F.when(F.col(c) != "", F.sha2(c, 256))
    rows = rows.select("doc_id", F.sha2("form", 256).alias("digest"), found("form").alias("whole"), found("line").alias("end"))
    rows = rows.join(known.select(F.col("digest").alias("whole"), "license"), "whole", "left")
    rows = rows.join(known.select(F.col("digest").alias("end"), F.col("license").alias("notice")), "end", "left")
    return rows.select("doc_id", "digest", "license", "notice")


def op5_license_scans(spark, sf_dir: str) -> DataFrame:
    """Query: every document against the known license texts."""
    return scan_licenses(read(spark, sf_dir, "documents"))
