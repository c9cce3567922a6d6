"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (ASCII lower case, copyright lines out,
equivalent spellings made one, punctuation and white space to single blanks)
and its digest is joined with the digests of known licence texts.  Two kinds of
unit are looked up whole: the entire document, and each of its lines (a notice
such as a one-line grant stands on a line of its own).  Known texts are a
parameter; those below are public licence texts and notices.

Defined results: null text is the empty text; a unit whose canonical form is
empty matches nothing; rows that repeat a doc_id and text give equal rows; a null
doc_id is one like any other; an empty table gives an empty result; columns
other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.common import ascii_lower, lookup, staged, table, text_or_empty

# Public licence texts.
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
#: Whole texts in files, by licence.
FILES = Path(__file__).with_name("licence_texts")
#: Titles that stand before texts which don't begin with one.
TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'), "Unlicense": ("The Unlicense", "Unlicense")}


def variants(name: str, text: str) -> list[str]:
    """The text as it is usually given: titled, without the advice after its terms, with either form
    of its links, and with each paragraph on one line (a wrapped line may begin with "copyright")."""
    found = [text]
    for title in TITLES.get(name, ()):
        found.append(f"{title}\n\n{text}")
    if name.startswith("BSD"):
        found += [f"{before}All rights reserved.\n\n{text}" for before in ("", *(f"{t}\n\n" for t in TITLES[name]))]
    found += [ended[0] for t in tuple(found) if (ended := re.match(r"(?s).*?END OF TERMS AND CONDITIONS", t))]
    found += [t.replace(a, b) for t in tuple(found) for a, b in (("http://", "https://"), ("https://", "http://"))]
    found += [re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t) for t in tuple(found)]
    return list(dict.fromkeys(found))


#: (licence, text): whole texts, then notices, then whole texts of files.
KNOWN = [
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    *((path.stem, text) for path in sorted(FILES.glob("*.txt")) for text in variants(path.stem, path.read_text(encoding="utf-8"))),
]
#: (spelling, the one it counts as), applied as whole words in this order.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("favour", "favor"), ("organisation", "organization"), ("per cent", "percent")]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r"
#: (?d): only a line feed ends a line.
COPYRIGHT_LINE = r"(?md)^[ \t]*(?:copyright|\(c\)|©)[^\n]*"


def canonical(column: str | Column) -> Column:
    """The form that is digested: words between single blanks."""
    low = ascii_lower(text_or_empty(column))
    # Lambdas name what was computed; the costly replacements run only where a plain search finds their words.
    return named(low, lambda t: F.when(holds(t, "copyright", "(c)", "©"), F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t), spaced, respelled_where_needed)


def named(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after the other, each over a value that is computed once."""
    for step in steps:
        value = F.transform(F.array(value), step)[0]
    return value


def holds(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION)), "  +", " "))


def respelled_where_needed(form: Column) -> Column:
    return F.when(holds(form, *(a for a, _ in SPELLINGS)), respelled(form)).otherwise(form)


def respelled(form: Column) -> Column:
    for spelling, one in SPELLINGS:
        form = F.regexp_replace(form, rf"\b{spelling}\b", one)
    return form


def digest(column: str | Column) -> Column:
    return F.sha2(canonical(column), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest and licence of the known texts (the first name of a digest counts), and the letters
    and digits that a text of that form has at least and at most (some spellings are longer)."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "place int, licence string, body string")
    rows = rows.select("place", "licence", canonical("body").alias("form")).where("form <> ''")
    least = F.length(F.replace("form", F.lit(" "), F.lit("")))
    longer = sum((F.regexp_count("form", F.lit(one)) * max(0, len(a) - len(one)) for a, one in SPELLINGS), F.lit(0))
    return staged(rows.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min_by("licence", "place").alias("licence"), F.max(least).alias("least"), F.max(least + longer).alias("most")), "licences")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_digest, licence (of the whole text), n_notices, notices.

    ``notices`` are the distinct licences of its lines, sorted, comma-joined.
    Only lines with as many letters and digits as some known text can have are
    brought to the canonical form.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "body"))
    sizes = staged(known.select(F.explode(F.sequence("least", "most")).alias("size")).distinct(), "sizes")
    lines = lookup(lines.withColumn("size", F.length(F.translate("body", PUNCTUATION + " ", ""))), sizes, ["size"], row_bytes=32)
    hits = lookup(lines.select("doc_id", "tk", "line", digest("body").alias("digest")), known.select("digest", "licence"), ["digest"], row_bytes=256)
    hits = hits.distinct().groupBy("doc_id", "tk").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("found"))
    hits = hits.select(F.col("doc_id").alias("_id"), "tk", "n", "found")
    whole = docs.select("doc_id", F.xxhash64("text").alias("_tk"), digest("text").alias("digest"))
    whole = lookup(whole, known.select("digest", "licence"), ["digest"], row_bytes=256, how="left")
    out = whole.join(hits, whole["doc_id"].eqNullSafe(hits["_id"]) & (whole["_tk"] == hits["tk"]), "left")
    return out.select("doc_id", F.col("digest").alias("text_digest"), "licence", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("found", F.lit("")).alias("notices"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and the licences found in it."""
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_form(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    marks = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    out = rf"regexp_replace(translate(coalesce({column}, ''), '{upper}', '{lower}'), '(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*', '', 'g')"
    out = f"trim(regexp_replace(translate({out}, '{marks}' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), repeat(' ', {len(PUNCTUATION)})), ' +', ' ', 'g'))"
    for spelling, one in SPELLINGS:
        out = rf"regexp_replace({out}, '\b{spelling}\b', '{one}', 'g')"
    return out


def oracle() -> str:
    known = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(KNOWN))
    return rf"""
WITH k AS (SELECT sha256({_sql_form("body")}) AS digest, arg_min(licence, place) AS licence FROM (VALUES {known}) v(place, licence, body) GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_form("text")}) AS text_digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body FROM documents),
h AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS found
      FROM (SELECT doc_id, sha256({_sql_form("body")}) AS digest FROM l) JOIN k USING (digest) GROUP BY 1)
SELECT d.doc_id, d.text_digest, k.licence, coalesce(h.n, 0)::BIGINT AS n_notices, coalesce(h.found, '') AS notices
FROM d LEFT JOIN k ON k.digest = d.text_digest LEFT JOIN h USING (doc_id)
"""


QUERIES = {"op7_licences": op7_licences}
ORACLES = {"op7_licences": oracle()}
