"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright statements dropped, equivalent
spellings made one, all but letters and digits made single spaces. Its SHA-256 is looked up
among the digests of known licences by a hash join. The whole text of a document is looked up,
and so is each of its lines, where notices stand; only lines that match are moved. Rows with
the same id and text share their matches.

Defined results: a null or empty text, or one that is empty in canonical form, matches
nothing. Rows and ids that repeat are all kept; null ids are kept. Several licences with one
canonical form are one licence, the first by name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.session import stage

# Equivalent spellings, as whole words of the canonical form.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization",
    "authorised": "authorized", "whilst": "while", "favour": "favor", "fulfil": "fulfill", "noncommercial": "non commercial",
    "merchantibility": "merchantability", "sub license": "sublicense", "per cent": "percent", "copyright holder": "copyright owner",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Public licence texts and the notices that stand for them; longer texts are in licence_texts.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]

COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright (\(c\) ?|© ?)?[0-9]{4}|© ?[0-9]{4}|\(c\) ?[0-9]{4}|all rights reserved)[^\n]*$"  # of canonical_sql only
NOT_WORD = r"[^\p{L}\p{N}]+"

# Every known form holds one of these within a word. Dropping statements, punctuation and spellings
# never makes one, so a line without any of them, in lower case, is no known text.
ANCHOR = "(licen|permission|redistribution)"

# Copyright statements, in lower case. A licence's own prose speaks of "copyright notices" and the like.
_PROSE = (r"(?!(?:notices?|holders?|owners?|licen[cs]es?|licensing|laws?|interests?|statements?|acts?|protections?|treat(?:y|ies)|rights?|permissions?|"
          r"disclaimers?|claims?|infringements?|restrictions?|terms|and|or|in|on|of|to|for|with|as|is|if|at|that|which|the|this|under|information|file)\b)")
_YEAR = r"(?=[0-9]{4}\b|[<\[{]\s*(?:years?|yyyy)\b)"
_MARK = (r"(?:\bcopyright[ \t:]*(?:\(c\)|©|&copy;)|(?:©|&copy;|\(c\))[ \t]*copyright\b|©|&copy;|\(c\)[ \t]*" + _YEAR
         + r"|\bcopyright[ \t:]*(?:by[ \t]+)?" + _YEAR + ")")
_OPENING = (r"\b(?:permission (?:is|to)\b|licen[cs]ed\b|released under|distributed under|redistribution and|spdx-license|everyone is permitted|"
            r"this (?:software|work|program|file|library|project|source)\b|(?:the )?(?:mit|isc|apache|bsd(?: [0-9][- ]clause)?) licen[cs]e|gnu (?:lesser )?general)")
_SENTENCE_END = r"(?<!\b(?:inc|ltd|co|corp|llc|jr|sr|dr|\p{L}))\.(?=\s|$)"
_START = r"(?m)^[ \t#*/;%.\-\"!<>|]*(?:portions )?"
# A short line from its mark to the licence's opening words or its end.
_SHORT_LINE = _START + "(?:" + _MARK + r"|copyright[ \t:]+" + _PROSE + r"(?=[\p{L}<\[{]))[^\n]{0,100}?(?=[ \t]*$|" + _OPENING + ")"
_SHORT_C = _START + r"\(c\)[ \t]+[^\n]{1,100}?(?=[ \t]*$|" + _OPENING + ")"
# Elsewhere the statement to its sentence's end or the opening words, or if neither is near, the mark and its years.
_STATEMENT = ("(?m)(?:" + _MARK + r"|\bcopyright[ \t:]+" + _PROSE + r"(?=[^\n.]{1,60}?\b[0-9]{4}\b|[^\n.]{1,80}?" + _OPENING + "))"
              r"(?:[^\n]{0,200}?(?:" + _SENTENCE_END + "|(?=$|" + _OPENING + r"))|[ \t]*(?:[0-9][0-9, \t-]*)?)")
_RESERVED = r"(?m)^(?:(?!" + _OPENING + r")[^\n]){0,100}?\ball rights reserved\b[^\n\p{L}\p{N}]*$|\ball rights reserved\b"


def canonical(text: str | Column) -> Column:
    """The canonical form. Most texts have no copyright line, which a plain search finds out sooner.

    A line that starts with a bare (c) is a statement unless the text has a (b) before: items of lists.
    """
    out = F.lower(F.col(text) if isinstance(text, str) else text)
    marked = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("\u00a9")) | F.contains(out, F.lit("(c)")) \
        | F.contains(out, F.lit("&copy;")) | F.contains(out, F.lit("all rights reserved"))
    stated = F.regexp_replace(out, _SHORT_LINE, " ")
    stated = F.when(F.contains(out, F.lit("(c)")) & ~F.contains(out, F.lit("(b)")), F.regexp_replace(stated, _SHORT_C, " ")).otherwise(stated)
    stated = F.regexp_replace(F.regexp_replace(stated, _STATEMENT, " "), _RESERVED, " ")
    out = F.when(marked, stated).otherwise(out)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, " ")), F.lit(" "))
    for said, meant in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The SQL expression of the tests for DuckDB; of copyright statements it knows whole lines with a year only."""
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"(' ' || trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g')) || ' ')"
    for said, meant in SPELLINGS.items():
        out = f"replace({out}, ' {said} ', ' {meant} ')"
    return f"trim({out})"


def digest(text: str | Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the packaged whole texts, and the forms they are met in.

    With and without the title of a BSD licence, the numbers of its clauses and Apache's appendix.
    """
    out = []
    for file in sorted(files("ledgerloom.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        forms = [text]
        if name == "Apache-2.0":
            forms.append(text[:text.index("APPENDIX:")])
            forms.append(text[:text.index("END OF TERMS")])
        if name.startswith("BSD"):
            body = text[text.index("Redistribution and use"):]
            title = f"BSD {name[4]}-Clause License\n"
            forms = [t + b for b in (body, re.sub(r"(?m)^\s*[0-9]\.\s+", "", body)) for t in ("", title, "The " + title)]
        out += [(name, f) for f in forms]
    return out


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, anchor), one row per digest; ``anchor`` is part of every text with that digest, or null."""
    rows = spark.createDataFrame(list(known or KNOWN + known_texts()), "license string, text string")
    anchor = F.regexp_extract(canonical("text"), ANCHOR, 1)
    return rows.select(digest("text").alias("digest"), "license", F.when(anchor != "", anchor).alias("anchor")).where(
        "digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"), F.min("anchor").alias("anchor"))


def worth_a_look(text: str | Column, anchors: list[str | None]) -> Column:
    """Whether a text can be one of those the anchors are from; a null anchor is met by any text."""
    if None in anchors:
        return F.lit(True)
    low, out = F.lower(text), F.lit(False)
    for anchor in anchors:
        out = out | F.contains(low, F.lit(anchor))
    return out


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, license, notices): the licence that the whole text is, and those whose text is one of its lines.

    The known table has one row per known licence and is a list kept by hand. It is written
    first, so that Spark knows its size when it plans: it broadcasts the table while that
    allows, and otherwise hash-joins on the digest. Lines are brought to their canonical form
    only if they hold an anchor of the table: at most the few of ``ANCHOR`` are collected.
    """
    known = stage(known if "anchor" in known.columns else known.withColumn("anchor", F.lit(None).cast("string")), "known")
    anchors = [r.anchor for r in known.select("anchor").distinct().collect()]
    known = known.drop("anchor")
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    whole = kept.select("_id", "_hash", digest("_text").alias("digest"))
    lines = kept.where(worth_a_look("_text", anchors)).select("_id", "_hash", F.explode(F.split("_text", "\n")).alias("_line"))
    lines = lines.where(worth_a_look("_line", anchors)).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), digest("_line").alias("digest")).join(known, "digest")
    lines = lines.groupBy("_i", "_h").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return whole.join(known, "digest", "left").join(
        lines, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left").select(
        F.col("_id").alias(id_col), "digest", "license", "notices")
