"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright lines out,
everything but letters and digits to single blanks, equivalent spellings to
one), its SHA-256 is taken, and digests are hash-joined with those of the known
licences.  The whole document is one unit, and so is each of its lines, which
finds notices inside other text.

All of it is DataFrame functions.  The table of known digests has a row or two a
known text (``KNOWN`` under its titles, ``WHOLE_TEXTS``; under a hundred), so it
is broadcast; units that match nothing are dropped by the join before anything
is shuffled.  Most texts hold no licence: units are respelled and hashed only
if they begin with two words that some known text begins with, in any spelling.

Coverage: whole texts of MIT, ISC, 0BSD, BSD-2/3-Clause, Zlib, Apache-2.0,
Artistic-1.0-Perl, CC0-1.0, GFDL-1.2/1.3, GPL-1/2/3, LGPL-2/2.1/3, MPL-1.1/2.0 and
the usual one-line notices of some of them.

Rows: NULL and blank texts match nothing; NULL ids are reported as NULL;
repeated rows of one id are counted together; an empty table gives an empty
result; texts are read whole.  Only id and text are read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column

# Spellings that licence comparison treats as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

# Public licence texts and notices by SPDX name.
KNOWN = (
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

# SHA-256 of the canonical form of whole public licence texts, with and without the part that tells how to apply them.
WHOLE_TEXTS = (
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "925dba96dda1b00cd8ff146661df40b6b2a302af5bf2f1243976eddb6d5a8450"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "0cb0736777286efc71748df95c0748e42cbf34246d31f42e488fded6114061ce"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "df71f3c423c11bc52456a9775329f1d9a3168a6f071654750b9eb155fb3ec0eb"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "18285bb1ad96820bff9c9d0ad8afd287be81e1fb278bd99ca194d3a69d622294"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
# The first two canonical words of those texts.
WHOLE_STARTS = ("apache license", "the artistic", "creative commons", "gnu free", "gnu general", "gnu lesser", "gnu library", "mozilla public")
# Titles under which a licence may stand, or none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", ""),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", ""),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", ""),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", ""),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", ""),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license", ""),
}
# Every known text holds one of these in lower case, within a word, so that no spelling or punctuation parts them.
MARKS = ("licen", "permission", "redistribution", "warranty")

# The patterns of the canonical form, in the common part of Java's and RE2's syntax.
COPYRIGHT_LINE = r"^[ \t#*/;-]*((portions )?copyright[ \t:]*(\(c\)|©|[0-9]|\[|<|\{|by |the )|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved\.?[ \t]*$)[^\n]*$"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F«»–—‘’“”…]+"


def light_line(line: Column) -> Column:
    """A line in lower case without punctuation; blank if it is a copyright line."""
    lower = F.lower(line)
    return F.trim(F.regexp_replace(F.when(lower.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(lower), NOT_A_WORD, " "))


def respelled(text: Column) -> Column:
    """Equivalent spellings made one, line by line (a spelling of two words must stand on one line to be joined)."""
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_units(docs: DataFrame, starts: list[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, scope, digest``: scope "text" once a row, "line" once a non-blank line; blank units are left out.

    With ``starts`` (the first two words that known forms may have, in any
    spelling) only units that begin so are respelled and hashed, and only texts
    that hold one of ``MARKS`` are looked at; no other unit can match.
    """
    table = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    if starts is not None:
        low = F.lower("text")
        table = table.where(reduce(or_, [F.contains(low, F.lit(m)) for m in MARKS]))
    table = table.select("doc_id", F.filter(F.transform(F.split(F.col("text"), "\n"), light_line), lambda x: x != "").alias("lines")).where(F.size("lines") > 0)
    begins = (lambda x: F.substring_index(x, " ", 2).isin(starts)) if starts is not None else (lambda x: F.lit(True))
    text = F.when(begins(F.array_join(F.slice("lines", 1, 2), " ")), F.array(F.struct(F.lit("text").alias("scope"), F.array_join(F.transform("lines", respelled), " ").alias("form")))).otherwise(F.expr("cast(array() as array<struct<scope:string,form:string>>)"))
    lines = F.transform(F.filter("lines", begins), lambda x: F.struct(F.lit("line").alias("scope"), respelled(x).alias("form")))
    return table.select("doc_id", F.explode(F.concat(text, lines)).alias("u")).select("doc_id", "u.scope", F.sha2("u.form", 256).alias("digest"))


def known_texts() -> list[tuple[str, str]]:
    """``KNOWN`` under each of their titles."""
    return [(name, f"{title}\n{text}") for name, text in KNOWN for title in (TITLES[name] if name in TITLES and len(text) > 200 else ("",))]


def known_starts() -> list[str]:
    """The first two words of each known form in every spelling that leads to it."""
    found = set()
    for start in [*WHOLE_STARTS, *(t for _, t in known_texts())]:
        light = " ".join(re.sub(NOT_A_WORD, " ", start.lower()).split()[:4])
        found.add(light)
        # the canonical form of a start may come from other spellings of it
        for _ in range(2):
            found |= {f.replace(a.strip(), b.strip()) for f in found for pair in SPELLINGS for a, b in (pair, pair[::-1])}
    return sorted({" ".join(f.split()[:2]) for f in found})


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license`` of the known texts, by the same canonical form, and of ``WHOLE_TEXTS``."""
    texts = canonical_units(spark.createDataFrame(known_texts(), "doc_id string, text string")).where("scope = 'text'")
    return texts.select("digest", F.col("doc_id").alias("license")).unionByName(spark.createDataFrame(list(WHOLE_TEXTS), "license string, digest string")).distinct()


def license_matches(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, license, scope, n``: how many units of a document are that licence.

    ``known`` (digest, license) may be a table of any size; it is joined as
    Spark sees fit.  The list of this module is broadcast.
    """
    if known is None:
        found = canonical_units(docs, known_starts()).join(F.broadcast(known_digests(docs.sparkSession)), "digest")
    else:
        found = canonical_units(docs).join(known.select("digest", "license").distinct(), "digest")
    return found.groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lower = "lower(l)"
    line = f"trim(regexp_replace(CASE WHEN regexp_matches({lower}, {quote(COPYRIGHT_LINE)}) THEN '' ELSE {lower} END, {quote(NOT_A_WORD)}, ' ', 'g'))"
    for old, new in SPELLINGS:
        line = f"replace({line}, {quote(old)}, {quote(new)})"

    def units(source: str, key: str) -> str:
        return f"""
          SELECT id, scope, sha256(form) AS digest FROM (
            SELECT id, 'text' AS scope, array_to_string(lines, ' ') AS form FROM {source}
            UNION ALL SELECT id, 'line' AS scope, unnest(lines) AS form FROM {source}) AS {key} WHERE form <> ''"""

    def lines(table: str, key: str) -> str:
        return f"SELECT {key} AS id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {line}), lambda x: x <> '') AS lines FROM {table}"

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in known_texts())
    whole = ", ".join(f"({quote(d)}, {quote(n)})" for n, d in WHOLE_TEXTS)
    return f"""
    WITH known_texts(name, text) AS (VALUES {values}), known_lines AS ({lines("known_texts", "name")}), doc_lines AS ({lines("documents", "doc_id")}),
    known AS (SELECT DISTINCT digest, id AS license FROM ({units("known_lines", "k")}) AS a WHERE scope = 'text' UNION SELECT * FROM (VALUES {whole})),
    found AS ({units("doc_lines", "d")})
    SELECT f.id AS doc_id, license, scope, count(*) AS n FROM found AS f JOIN known USING (digest) GROUP BY ALL"""
