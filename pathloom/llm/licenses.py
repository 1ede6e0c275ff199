"""Licence scans by canonical digests, in DataFrame operations only.

A text is lower-cased, copyright lines go, punctuation becomes spaces, equivalent
spellings become one, and the SHA-256 of what is left is joined to the digests of
known licences. The lines of the same canonical text are looked up among known
notices, so a document that carries a notice is found as well as one that is a
licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.license_digests import DIGESTS

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Texts of licences, with and without their title line.
TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_START}{_BSD_END}"),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_START}{_BSD_NAMES}{_BSD_END}"),
]
# One-line notices.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
]
# What one spelling replaces another by; groups 1 and 2 stay.
SPELLINGS: list[tuple[str, str]] = [
    (r"\b(licen)c(e|es|ed|ing|ee|or)\b", "{1}s{2}"),
    (r"\b(sub|non) (licens|commercial|infring)", "{1}{2}"),
    (r"\b(favo|behavio|colo|hono|labo)u(r)", "{1}{2}"),
    (r"\b(acknowledg|judg)e(ment)", "{1}{2}"),
    (r"\b(author|organ|real|recogn|util|initial|custom)is(e|ed|es|ing|ation)\b", "{1}iz{2}"),
    (r"\b(copyright) owner(s?)\b", "{1} holder{2}"),
    (r"\b(whil)st()\b", "{1}e{2}"),
]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by\b|<|\[)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
ENDS = r"(?m)^ +| +$"


def canonical(text: Column) -> Column:
    """The text in canonical spelling, its lines kept apart."""
    text = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), PUNCTUATION, " ")
    for pattern, to in SPELLINGS:
        text = F.regexp_replace(text, pattern, to.format("", "$1", "$2"))
    return F.regexp_replace(text, ENDS, "")


def digest(lines: Column) -> Column:
    """Of a canonical text, however its lines are broken."""
    return F.sha2(F.trim(F.regexp_replace(lines, r"\n+", " ")), 256)


def known(spark, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, license, length of the canonical text) of known texts."""
    rows = spark.createDataFrame(texts, "license string, text string")
    return rows.select(digest(canonical(F.col("text"))).alias("digest"), "license", F.length(canonical(F.col("text"))).alias("length")).distinct()


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license, notices and n_notices of every document.

    license is that of the entire text, null if it is none that is known (should
    two known texts share a digest, the smallest name). notices holds the
    licences that the document's lines announce, sorted, distinct, joined by
    commas; n_notices counts such lines. A null text has a null digest and no
    notice; an empty text has the digest of nothing; null ids stay null; texts and
    lines of any length count whole; repeated rows repeat; an empty table gives an
    empty result; other columns are left aside. The known tables are parameters of
    the caller, so they may be broadcast.
    """
    spark = docs.sparkSession
    whole = known(spark, TEXTS if texts is None else texts).select("digest", "license")
    if texts is None:
        whole = whole.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string"))
    whole = whole.groupBy("digest").agg(F.min("license").alias("license"))
    table = known(spark, NOTICES if notices is None else notices).groupBy("digest").agg(F.min("license").alias("license"), F.min("length").alias("length"))
    lookup = table.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("lookup"), F.collect_set("length").alias("lengths"))
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("lines"))
    rows = rows.withColumn("digest", digest(F.col("lines"))).crossJoin(F.broadcast(lookup))  # one row
    hits = F.filter(F.transform(F.filter(F.split("lines", "\n"), lambda x: F.array_contains("lengths", F.length(x))), lambda x: F.try_element_at("lookup", F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.withColumn("hits", F.coalesce(hits, F.array().cast("array<string>"))).join(F.broadcast(whole), "digest", "left")
    return rows.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"), F.size("hits").cast("bigint").alias("n_notices"))


def oracle() -> str:
    """The same scan in DuckDB SQL."""

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"regexp_replace(regexp_replace(lower({x}), {lit(COPYRIGHT_LINE)}, '', 'g'), {lit(PUNCTUATION)}, ' ', 'g')"
        for pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, {lit(pattern)}, {lit(to.format('', chr(92) + '1', chr(92) + '2'))}, 'g')"
        return f"regexp_replace({x}, {lit(ENDS)}, '', 'g')"

    def dig(x: str) -> str:
        return f"sha256(trim(regexp_replace({x}, '\\n+', ' ', 'g')))"

    def table(rows: list[tuple[str, str]]) -> str:
        return f"(SELECT {dig(canon('t'))} AS digest, min(l) AS license FROM (VALUES {', '.join(f'({lit(a)}, {lit(b)})' for a, b in rows)}) AS v(l, t) GROUP BY 1)"

    return f"""
WITH whole AS {table(TEXTS)}, notice AS {table(NOTICES)},
c AS (SELECT doc_id, {canon('text')} AS lines, row_number() OVER () AS r FROM documents),
d AS (SELECT *, {dig('lines')} AS digest FROM c),
l AS (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM c),
h AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
      FROM l JOIN notice ON sha256(line) = notice.digest WHERE contains(line, 'licens') GROUP BY r)
SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices
FROM d LEFT JOIN whole ON d.digest = whole.digest LEFT JOIN h ON d.r = h.r"""
