"""License scans by canonical digests.

A text is brought to canonical form (ASCII lower case, equivalent spellings, no copyright
lines, no punctuation, single spaces) and hashed as a whole; the digest is joined with the
digests of known license texts and notices.  Every line is looked up in the same way, since
a notice is often one whole line of a longer document.

DataFrame functions only.  Scale: one pass; the known digests are a fixed list of under a
hundred rows and are broadcast; a row's units are aggregated before the only, narrow shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII controls, spaces and punctuation, no-break space, and typographic marks.
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{AB}\x{B7}\x{BB}\x{2010}-\x{2027}]+"
#: A canonical line that only states copyright.
COPYRIGHT = r"^(copyright c( .*)?|copyright( c)? (by|[0-9]{4})( .*)?|c [0-9]{4}( .*)?|all rights reserved( .*)?)$"
#: Spellings that license matching takes as equal, applied in this order.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("recognise", "recognize"),
    ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("fulfil ", "fulfill "), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
]
#: Notices, as (SPDX identifier, text).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Whole license texts without their copyright lines, as (SPDX identifier, text).
TEXTS = [
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
#: License identifiers whose one-line SPDX notice is known as well.
IDENTIFIERS = sorted({i for i, _ in NOTICES + TEXTS} | {
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSL-1.0", "EPL-2.0", "GPL-2.0-or-later", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-3.0-only", "Unlicense"})


def known() -> list[tuple[str, str]]:
    """All known texts, as (identifier, text); a text with and without its title line."""
    untitled = [(i, t.split("\n", 2)[2]) for i, t in TEXTS]
    return NOTICES + TEXTS + untitled + [(i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS]


def canonical_line(line: Column) -> Column:
    out = F.replace(F.translate(line, UPPER, LOWER), F.lit("©"), F.lit("(c)"))
    out = F.btrim(F.regexp_replace(out, PUNCTUATION, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty and copyright lines."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: (x != "") & ~F.rlike(x, F.lit(COPYRIGHT)))


def digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, license)`` of the known texts (the module's own unless given); one row per digest."""
    listed = [F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in texts or known()]
    rows = spark.range(0, 1, 1, 1).select(F.inline(F.array(*listed)))
    lines = rows.select("license", canonical_lines(F.col("text")).alias("lines"))
    return (lines.select(F.sha2(F.array_join("lines", " "), 256).alias("digest"), "license")
            .groupBy("digest").agg(F.min("license").alias("license")))


def license_scan(df: DataFrame, *, key: str = "doc_id", text: str = "text",
                 texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: key, ``text_digest``, ``text_license``, ``line_licenses`` and ``n_license_lines``.

    ``text_license`` is the license whose known text the whole text is, in canonical form;
    ``line_licenses`` lists (sorted, comma-separated) those of single lines, null without any.
    Null texts count as empty: the digest of the empty text, no license.  Repeated rows give
    a row each; other columns are dropped.
    """
    row = free_name(df, "_row")
    units = (df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias(row),
                       canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
             .select("key", row, "lines", F.array_join("lines", " ").alias("whole"))
             .select("key", row, F.posexplode(F.concat(F.array("whole"), "lines")).alias("at", "unit"))
             .select("key", row, "at", F.sha2("unit", 256).alias("digest")))
    found = units.join(F.broadcast(digests(df.sparkSession, texts)), "digest", "left")
    line = F.when(F.col("at") > 0, F.col("license"))
    whole = lambda c: F.max(F.when(F.col("at") == 0, F.col(c)))
    out = found.groupBy("key", row).agg(
        whole("digest").alias("text_digest"), whole("license").alias("text_license"),
        F.array_sort(F.collect_set(line)).alias("all"), F.count(line).alias("n_license_lines"))
    return out.select(F.col("key").alias(key), "text_digest", "text_license",
                      F.when(F.size("all") > 0, F.array_join("all", ",")).alias("line_licenses"), "n_license_lines")


def oracle_sql() -> str:
    """The same in DuckDB SQL over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spell = f"trim(regexp_replace(replace(translate(x, '{UPPER}', '{LOWER}'), '©', '(c)'), '{PUNCTUATION}', ' ', 'g'))"
    for a, b in SPELLINGS:
        spell = f"replace({spell}, '{a}', '{b}')"
    lines = (f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {spell}), "
             f"lambda y: y <> '' AND NOT regexp_matches(y, '{COPYRIGHT}'))")
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known())
    return f"""
WITH k AS (
  SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license) AS license
  FROM (VALUES {values}) v(license, t) GROUP BY 1),
d AS (
  SELECT doc_id, row_number() OVER () AS r, {lines} AS ls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
u AS (
  SELECT doc_id, r, 0 AS unit, sha256(array_to_string(ls, ' ')) AS digest FROM d
  UNION ALL
  SELECT doc_id, r, 1, sha256(x) FROM (SELECT doc_id, r, unnest(ls) AS x FROM d))
SELECT doc_id, max(digest) FILTER (unit = 0) AS text_digest, max(license) FILTER (unit = 0) AS text_license,
       nullif(array_to_string(list_sort(list(DISTINCT license) FILTER (unit > 0 AND license IS NOT NULL)), ','), '')
         AS line_licenses,
       count(license) FILTER (unit > 0) AS n_license_lines
FROM u LEFT JOIN k USING (digest) GROUP BY doc_id, r
"""
