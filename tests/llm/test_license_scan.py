import textwrap

from kohort.llm import license_scan as s
from tests.llm.data import clashing, docs


def got(spark, rows):
    out = s.scanned(clashing(docs(spark, rows)), s.known_digests(spark)).collect()
    return sorted(((r.doc_id, r.license_id, r.n_license_lines, r.line_licenses) for r in out), key=str)


def test_spellings_punctuation_and_copyright_lines(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + s.MIT.upper().replace(",", " ;").replace("SUBLICENSE", "sublicence")
    rows = [(1, mit), (2, s.MIT + " and more"), (3, "prose\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0\nend"),
            (4, "RELEASED UNDER THE MIT LICENSE!!"), (5, ""), (5, ""), (6, None), (None, "Licensed under the Apache License, Version 2.0."),
            (7, "Licensed under the Apache License, v2.0"), (8, "x\n" * 30000), (9, "Copyright only"),
            (10, "Released under the MIT License.\n" * 3), (10, "Released under the MIT License.\n" * 3)]
    assert got(spark, rows) == sorted([
        (1, "MIT", 0, ""), (2, None, 0, ""), (3, None, 2, "CC-BY-NC-4.0,MIT"), (4, "MIT", 1, "MIT"), (5, None, 0, ""), (5, None, 0, ""),
        (6, None, 0, ""), (None, "Apache-2.0", 1, "Apache-2.0"), (7, "Apache-2.0", 1, "Apache-2.0"), (8, None, 0, ""), (9, None, 0, ""),
        (10, None, 3, "MIT"), (10, None, 3, "MIT")], key=str)
    assert got(spark, []) == []


def test_wrapping_does_not_matter(spark):
    bodies = {"MIT": s.MIT, "ISC": s.ISC, "BSD-2-Clause": s._bsd(2, "{}. "), "BSD-3-Clause": s._bsd(3, "* "), "Zlib": s.ZLIB,
              "Unlicense": s.UNLICENSE}
    rows, want = [], []
    for name, body in bodies.items():
        forms = [" ".join(body.split()), *["\n".join(textwrap.wrap(" ".join(body.split()), w)) for w in range(30, 121, 10)]]
        for text in [*forms, *["Copyright (c) 2020 Some One\n\n" + f for f in forms], "© 2020 Some One, Inc. All rights reserved. " + forms[0]]:
            rows.append((len(rows), text))
            want.append(name)
    rows += [(len(rows), "MIT License Copyright (c) 2020 Some One " + " ".join(s.MIT.split()))]
    out = {r[0]: r[1] for r in got(spark, rows)}
    assert [out[k] for k in range(len(rows))] == [*want, "MIT"]


def test_only_statements_of_a_copyright_go(spark):
    from pyspark.sql import functions as F
    lines = ["copyright holders be liable", "(c) the licensee shall", "copyright laws of 1990", "# Copyright 2020 X", "(C) 2020 X", "All rights reserved.",
             "all rights reserved words are kept", "Copyright [yyyy] [name]"]
    df = docs(spark, list(enumerate(lines))).select("doc_id", s.canonical(F.col("text")).alias("c"))
    assert [r.c for r in df.orderBy("doc_id").collect()] == [
        "copyright holders be liable", "c the licensee shall", "copyright laws of 1990", "", "", "", "all rights reserved words are kept", ""]
