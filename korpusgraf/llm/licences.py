"""License scans by canonical digest lookup, in DataFrame functions only.

A text's canonical form: A-Z lower-cased, lines that hold a copyright notice left out, equivalent spellings made one, and every
run of other characters than letters and digits one space. Its MD5 is the digest. For the lookup, punctuation and symbols beyond ASCII
are spaces as well; the MD5 of that form is hash-joined to those of the known texts: notices (KNOWN) and entire licences (entire()). Whole
documents are looked up, every line as an entire text of its own, and every block between blank lines: a known text of n blocks stands in a
document where its n block digests follow each other. Comment marks are no letters, so licences in file headers are found the same way.

The SQL twin knows the notices and the texts in KNOWN only, and looks up the digest itself: it gives less than scan() where a document holds another
entire licence or has such punctuation.

Cases: null or empty text: digest of the empty form, no licence. Equal digests of several known texts would name the least licence.
Repeated rows and null doc_ids: each row is returned. Very long texts are read whole. Further columns of docs are not read.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusgraf.llm.common import ascii_lower

#: Equivalent spellings, applied in this order to the lower-cased text: literal ones, and patterns after them.
LITERALS = [("licence", "license"), ("organisation", "organization"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("https://", "http://"), ("&", " and ")]
SPELLINGS = [
    (r"\bver(sion|\.)? ?(\d)", r"v$2"), (r"\bv\.? ?(\d)", r"v$1"), (r"(\d)\.0\b", "$1"), (r"\bthe\b", " "),
]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"
BLOCK = "\x01"
#: A line break within a sentence of the terms before this word, where the next line is no notice.
WRAPPED = r"(?<=[^\s])[ \t]*\r?\n[^A-Za-z0-9\n]*(copyright|COPYRIGHT)(?=(?i:, [a-z]|\s+(?:notice|statement|holder|owner|law|licen[cs]e|interest|permission|disclaimer|treat|and|or|on the|in the|the software)))"

#: The texts of two licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Fixed values: (licence, an entire text by which it is known).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", ISC),
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
] + [(k, f"SPDX-License-Identifier: {k}") for k in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "ISC", "MIT", "MPL-2.0")]

#: Licence texts without a title, by the titles that files begin with. All others have their title in the text.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"],
    "ISC": ["ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "MIT License (MIT)"],
}


@cache
def entire() -> list[tuple[str, str]]:
    """(licence, text) of entire licences: with and without title, with and without what follows the terms, in their usual wordings."""
    texts = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))] + [("ISC", ISC), ("MIT", MIT)]
    out = []
    for name, text in texts:
        forms = [text]
        if name.startswith("BSD"):
            forms += [f.replace("HOLDER OR", "OWNER OR") for f in forms]
            forms += [re.sub(r"(?m)^[123]\.", "*", f) for f in forms]
            forms += [f"All rights reserved.\n\n{f}" for f in forms]
        if name == "ISC":
            forms += [f.replace("and/or distribute", "and distribute") for f in forms]
        if name == "BSL-1.0":
            forms.append(text.split("\n", 1)[1])
        if "END OF TERMS AND CONDITIONS" in text:
            terms = text[: text.index("END OF TERMS AND CONDITIONS")]
            forms += [terms, f"{terms}END OF TERMS AND CONDITIONS"]
        out += [(name, t + f) for f in forms for t in ["", *(f"{t}\n\n" for t in TITLES.get(name, []))]]
    return out


def line_forms(text: Column) -> Column:
    """The canonical form with its line breaks kept."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    notice = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    t = F.when(notice, F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    for literal, to in LITERALS:
        t = F.replace(t, F.lit(literal), F.lit(to))
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(t, r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")


def _flat(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def digest(text: Column) -> Column:
    return F.md5(_flat(line_forms(text)).cast("binary"))


def _plain(form: Column) -> Column:
    """A form with its line breaks, without punctuation, symbols, spaces and format marks beyond ASCII."""
    return F.regexp_replace(form, r"[ \p{P}\p{S}\p{Z}\p{Cf}\x{80}-\x{9F}]+", " ")


def _joined(plain: Column) -> Column:
    """Spellings with a hyphen are made one with any dash."""
    return F.regexp_replace(plain, r"\b(non|sub) (commercial|license)", "$1$2")


def with_keys(texts: DataFrame) -> DataFrame:
    """texts (text and others) with digest, key of the whole text, and keys of its lines and blocks: MD5 of their forms. A block is a run of lines whose
    forms hold something, so that comment marks and empty comment lines are no part of it. Line breaks before `copyright` within
    a sentence are taken away for whole texts and blocks."""
    form = texts.withColumn("form", line_forms(F.col("text"))).withColumn("plain", _plain(F.col("form")))
    wrapped = (F.contains("text", F.lit("copyright")) | F.contains("text", F.lit("COPYRIGHT"))) & F.col("text").rlike(WRAPPED)
    whole = F.when(wrapped, _plain(line_forms(F.regexp_replace("text", WRAPPED, " $1")))).otherwise(F.col("plain"))
    # Blocks end in a mark that no form holds, lines within one become words of it.
    blocks = F.translate(F.regexp_replace(F.regexp_replace(whole, r" *\n *", "\n"), "\n{2,}", BLOCK), "\n", " ")
    form = form.select(*texts.columns, "form", _joined(F.col("plain")).alias("lines"), _joined(blocks).alias("blocks"))
    keys = lambda parts: F.transform(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.md5(x.cast("binary")))
    key = F.md5(F.trim(F.translate("blocks", BLOCK, " ")).cast("binary"))
    return form.select(
        *texts.columns, F.md5(_flat(F.col("form")).cast("binary")).alias("digest"), key.alias("key"),
        keys(F.split("lines", "\n")).alias("line_keys"), keys(F.split("blocks", BLOCK)).alias("block_keys"),
    )


def known_units(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(kind, key, license, no, j, n) of the known texts, by the expressions that make the documents' keys: each as an entire text (kind
    text, and line), and its n blocks by number (kind block)."""
    keyed = with_keys(spark.createDataFrame(known, "license string, text string"))
    entire_ = keyed.groupBy("key").agg(F.min(F.struct("license", "block_keys")).alias("k")).select("key", "k.license", "k.block_keys")
    whole = entire_.select(F.explode(F.array(F.lit("text"), F.lit("line"))).alias("kind"), "key", "license", F.lit("").alias("no"), F.lit(0).alias("j"), F.lit(1).alias("n"))
    parts = entire_.select(F.lit("block").alias("kind"), F.posexplode("block_keys").alias("j", "key"), "license", F.col("key").alias("no"), F.size("block_keys").alias("n"))
    return whole.unionByName(parts)


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, text_license (of the whole text, or null), n_license_lines, line_licenses, block_licenses (distinct, sorted,
    comma-joined) of each row. A known text stands in a document where all its blocks stand one after the other."""
    known = KNOWN + entire() if known is None else known
    raw = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("raw")  # rows of one id and text are told by their number only
    keyed = with_keys(docs.select("doc_id", "text")).select("doc_id", raw, "digest", "key", "line_keys", "block_keys")
    unit = lambda kind, keys: F.transform(keys, lambda k, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), k.alias("key")))
    units = keyed.select("doc_id", "raw", "digest", F.explode(F.concat(unit("text", F.array("key")), unit("line", F.col("line_keys")), unit("block", F.col("block_keys")))).alias("u"))
    units = units.select("doc_id", "raw", "digest", "u.*")
    met = units.join(F.broadcast(known_units(docs.sparkSession, known)), ["kind", "key"], "left").where("kind = 'text' OR license IS NOT NULL")  # a fixed catalogue
    begins = F.when(F.col("kind") == "block", F.col("i") - F.col("j"))
    counted = met.groupBy("doc_id", "raw", "digest", "kind", "license", "no", "n", begins.alias("at")).agg(F.count("*").alias("c"))
    hits = F.collect_list(F.when(F.col("kind") == "block", F.struct("license", "n", "c")))
    of = counted.groupBy("doc_id", "raw", "digest").agg(
        F.max(F.when(F.col("kind") == "text", F.col("c"))).alias("rows"),
        F.max(F.when(F.col("kind") == "text", F.col("license"))).alias("text_license"),
        F.coalesce(F.sum(F.when(F.col("kind") == "line", F.col("c"))), F.lit(0)).alias("lines"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "line", F.col("license")))), ",").alias("line_licenses"),
        hits.alias("hits"),
    )
    whole = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: h["c"] >= h["n"] * F.col("rows")), lambda h: h["license"]))), ",")
    out = of.select("*", whole.alias("block_licenses"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "digest", "text_license", F.expr("lines div rows").alias("n_license_lines"), "line_licenses", "block_licenses")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t = rf"regexp_replace(translate(coalesce(%s, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    for pattern, to in LITERALS + SPELLINGS:
        to = to.replace("$", "\\")
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(to)}, 'g')"
    form = f"regexp_replace({t}, '[^a-z0-9\\n\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')"
    flat = "md5(trim(regexp_replace(%s, '[ \\n]+', ' ', 'g')))"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN)
    split = "list_filter(string_split_regex(regexp_replace(form, ' *\\n *', chr(10), 'g'), '\\n{2,}'), lambda b: trim(replace(b, chr(10), ' ')) <> '')"
    return f"""
WITH texts AS (SELECT k, {form % "x"} AS form FROM (VALUES {values}) AS t(k, x)),
known AS (SELECT {flat % "form"} AS digest, min({{'license': k, 'blocks': {split}}}) AS u FROM texts GROUP BY 1),
parts AS (SELECT digest AS no, u.license AS license, len(u.blocks) AS n, unnest(range(len(u.blocks))) AS j, unnest(u.blocks) AS b FROM known),
docs AS (SELECT row_number() OVER () AS r, doc_id, {form % "text"} AS form FROM documents),
lines AS (SELECT r, unnest(string_split(form, chr(10))) AS line FROM docs),
hits AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT u.license, ',' ORDER BY u.license) AS names
  FROM (SELECT r, {flat % "line"} AS digest FROM lines) JOIN known USING (digest) GROUP BY r),
blocks AS (SELECT r, unnest(range(len({split}))) AS i, unnest({split}) AS b FROM docs),
runs AS (
  SELECT r, license FROM (SELECT r, i, {flat % "b"} AS key FROM blocks) JOIN (SELECT *, {flat % "b"} AS key FROM parts) USING (key)
  GROUP BY r, license, no, n, i - j HAVING count(*) = n),
held AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM runs GROUP BY r)
SELECT doc_id, {flat % "form"} AS digest, known.u.license AS text_license, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines,
       coalesce(hits.names, '') AS line_licenses, coalesce(held.names, '') AS block_licenses
FROM docs LEFT JOIN known ON {flat % "form"} = known.digest LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""


SQL = _sql()
