"""Whole licence texts, wrapped as files have them, and notices after a copyright statement."""

import textwrap

import duckdb
import pytest

from slotwise.llm import license_scan as ls, license_texts as lt


@pytest.fixture
def cases():
    """(text, licences, licence of the whole text)"""
    owner = "Copyright (c) 2024 A. Body\nAll rights reserved.\n\n"
    wrap = lambda text, width=70: textwrap.fill(text, width)
    apache = (
        "   Copyright 2024 X\n\n   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file "
        "except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n"
    )
    gnu = (
        "    This program is free software; you can redistribute it and/or modify\n    it under the terms of the GNU General Public "
        "License as published by\n    the Free Software Foundation; either version 2 of the License, or\n    (at your option) any later version.\n"
    )
    return [
        ("MIT License\n\n" + owner + wrap(lt._GRANT), ["MIT"], "MIT"),
        *[(owner + wrap(lt._ISC, n), ["ISC"], "ISC") for n in (40, 55, 71)],
        (owner + wrap(lt._bsd(2, True), 72), ["BSD-2-Clause"], "BSD-2-Clause"),
        ("BSD 3-Clause License\n\n" + owner + wrap(lt._bsd(3, False)), ["BSD-3-Clause"], "BSD-3-Clause"),
        ("zlib License\n\n(C) 2024 X\n\n" + wrap(lt._ZLIB), ["Zlib"], "Zlib"),
        ("text\n\n" + apache, ["Apache-2.0"], None),
        ("text\n\n" + gnu + "\ntext", ["GPL-2.0-or-later"], None),
        ("text\nCopyright 2024 X. Licensed under CC BY 4.0.\nmore", ["CC-BY-4.0"], None),
        ("text\n© 2024 X. All rights reserved. Released under the MIT License.", ["MIT"], None),
        ("Copyright 2024 X. Other words.", [], None),
    ]


def test_whole_texts_and_notices_after_a_statement(spark, cases):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    known = spark.createDataFrame(ls.NOTICES + lt.TEXTS, "license string, text string")
    found = {r["doc_id"]: (r["licenses"], r["whole_license"]) for r in ls.scan(docs, known).collect()}
    assert found == {i: (names, whole) for i, (_, names, whole) in enumerate(cases)}


def test_the_sql_scans_alike(spark, cases):
    texts = [text for text, _, _ in cases]
    texts += [
        None, "", "\n\n", "copyright", "Copyright\n(c) X\nMIT License", "copy\x01right 2020 X\nReleased under the MIT License.",
        "Copyright notices are kept. Licensed under CC BY 4.0.", "copyright laws\ncopyright lawsuits Licensed under CC BY 4.0.",
        "  # Copyright 2024 X. Licensed under CC BY 4.0. Copyright 2025 Y.", "A (c) 2024 X. Licensed under CC BY 4.0.",
        "All rights reserved. Released under the MIT License. Released under the MIT License.",
    ]
    for name, text in ls.NOTICES + lt.TEXTS:
        texts += [f"Copyright 2024 {name}. {text}", f"x\n\n// (C) 2024\n{textwrap.fill(text, 60)}\n\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(ls.NOTICES + lt.TEXTS, "license string, text string")
    scanned = {
        r["doc_id"]: (",".join(r["licenses"]), r["n_license_units"], r["whole_license"])
        for r in ls.scan(docs, known).collect()
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert {row[0]: tuple(row[1:]) for row in con.execute(ls.SQL_6).fetchall()} == scanned
    assert sum(bool(names) for names, _, _ in scanned.values()) > len(ls.NOTICES + lt.TEXTS)
