"""Licence scan by digests of canonical texts.

A text is brought into a canonical form: lower case, copyright statements left out,
equivalent spellings made one, punctuation and white space one blank. The
digests of the whole document, of its paragraphs and of its lines are joined
with the digests of known licence texts and notices, treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.license_texts import TEXTS
from slotwise.llm.tables import read, without

OUT = ("licenses", "n_license_units", "whole_license")

# Short notices and first paragraphs of public licences, by SPDX identifier;
# whole texts and headers are in license_texts.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    )),
]

# Spellings that mean the same, after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("share alike", "sharealike"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("organisation", "organization"),
    ("per cent", "percent"), ("programme", "program"), ("recognise", "recognize"), ("version ", "v"), ("ver ", "v"), ("v ", "v"),
]
# A statement ends with its line or where a notice begins; lines of a wrapped licence are none.
_START = r"(?m)^[ \t*#/;-]*"
_OTHER = r"[ \t]+(?:notices?|holders?|owners?|and|or|laws?|license)\b"
_NOTICE = (
    r"\b(?:licen[sc]ed under|released under|distributed under|spdx-license-identifier|permission is hereby|permission to use|"
    r"redistribution and use|use of this source|to the extent possible|this (?:work|program|library|software|source code form|file) is)\b"
)
STATEMENT = rf"{_START}(copyright(?!{_OTHER})|\(c\)|©|all rights reserved)[^\n]*?(?=\n|\z|{_NOTICE})"


# Steps that cut the statements. DuckDB's patterns can't look ahead: what is no statement is marked
# first, and a notice that ends one is put back.
CUTS = [(STATEMENT, "")]
MARK = "copy\x01right"
CUTS_BY_CAPTURE = [
    (rf"({_START})copyright({_OTHER})", rf"\1{MARK}\2"),
    (rf"{_START}(?:copyright|\(c\)|©|all rights reserved)[^\n]*?({_NOTICE}|$)", r"\1"),
    (MARK, "copyright"),
]
# how to replace all, a backslash in a literal, and the cuts
SPARK = ("regexp_replace({0}, {1}, {2})", "\\\\", CUTS)
DUCKDB = ("regexp_replace({0}, {1}, {2}, 'g')", "\\", CUTS_BY_CAPTURE)


def _step(value: str, pattern: str, new: str, dialect: tuple[str, str, list]) -> str:
    replace, slash, _ = dialect
    return replace.format(value, "'" + pattern.replace("\\", slash) + "'", f"'{new}'")


def _words_only(text: str, dialect: tuple[str, str, list]) -> str:
    """SQL for lower case, without copyright statements, a blank for all that is no letter or digit."""
    kept = f"lower({text})"
    for pattern, new in dialect[2]:
        kept = _step(kept, pattern, new, dialect)
    return _step(kept, "[^a-z0-9]+", " ", dialect)


def _spelled(text: str, dialect: tuple[str, str, list]) -> str:
    """SQL for the same words in one spelling."""
    for old, new in SPELLINGS:
        text = _step(text, rf"\b{old}" + ("" if old.endswith(" ") else r"\b"), new, dialect)
    return f"trim({text})"


def canonical(text: str) -> str:
    """SQL for the canonical form of a text column; most texts hold no word to be respelled."""
    respell = r"\\b(" + "|".join(old for old, _ in SPELLINGS) + ")"
    return f"transform(array({_words_only(text, SPARK)}), c -> if(c rlike '{respell}', {_spelled('c', SPARK)}, trim(c)))[0]"


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` with the licences met in them.

    ``known`` has ``license`` and ``text``. Adds ``licenses`` (distinct,
    sorted), ``n_license_units`` (lines and paragraphs that are a known text;
    a paragraph of one line counts once) and ``whole_license`` (of the whole
    text, else null). A null or empty text, and a unit whose canonical form is
    empty, matches nothing. If two licences share a text, both are met, and the
    first by name is the whole text's. Rows with equal text get equal results;
    input columns with those names give way; either table may be empty.
    """
    digests = (
        known.select("license", F.expr(canonical("text")).alias("_c")).where("_c <> ''")
        .select("license", F.md5("_c").alias("_d")).distinct()
    )
    # results are found per digest of the text; copies of a text add up and are divided out
    base = without(docs, *OUT).withColumn("_t", F.md5(F.coalesce("text", F.lit(""))))
    # digests are made before the units become rows, so that no filter makes them again
    units = base.select(
        "_t",
        F.expr(
            "concat(array(struct(true as whole, text as unit)),"
            " transform(split(text, '\\n'), x -> struct(false as whole, x as unit)),"
            " transform(filter(split(text, '\\n[ \\t]*\\n'), x -> x like '%\\n%'), x -> struct(false as whole, x as unit)))"
        ).alias("_units"),
    ).select(
        "_t", F.explode(F.expr(f"transform(_units, u -> struct(u.whole as whole, md5({canonical('u.unit')}) as _d))")).alias("_u")
    ).select("_t", "_u.whole", "_u._d")
    met = units.join(digests, "_d")
    found = met.groupBy("_t").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"),
        F.count(F.when(~F.col("whole"), 1)).alias("_n"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
    )
    copies = base.groupBy("_t").agg(F.count("*").alias("_k"))
    found = found.join(copies, "_t").select(
        "_t", "licenses", (F.col("_n") / F.col("_k")).cast("long").alias("n_license_units"), "whole_license"
    )
    return (
        base.join(found, "_t", "left").drop("_t")
        .withColumn("licenses", F.coalesce("licenses", F.array().cast("array<string>")))
        .withColumn("n_license_units", F.coalesce("n_license_units", F.lit(0).cast("long")))
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: licences of its text, paragraphs and lines."""
    known = spark.createDataFrame(NOTICES + TEXTS, "license string, text string")
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), known)
    return found.select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), "n_license_units", "whole_license"
    )


def _duckdb() -> str:
    """The same steps for DuckDB."""
    form = lambda column: _spelled(_words_only(column, DUCKDB), DUCKDB)
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in NOTICES + TEXTS)
    return f"""
WITH known AS (
  SELECT DISTINCT license, md5({form("text")}) AS d FROM (VALUES {values}) AS t(license, text)
), units AS (
  SELECT doc_id, true AS whole, text AS unit FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT doc_id, false, unit FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS unit FROM documents) WHERE contains(unit, chr(10))
), met AS (
  SELECT doc_id, whole, license FROM (SELECT doc_id, whole, {form("unit")} AS c FROM units) JOIN known ON d = md5(c)
  WHERE c <> ''
), found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
    count(*) FILTER (WHERE NOT whole) AS n, min(license) FILTER (WHERE whole) AS w
  FROM met GROUP BY doc_id
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_license_units, w AS whole_license
FROM documents LEFT JOIN found USING (doc_id)
"""


SQL_6 = _duckdb()
