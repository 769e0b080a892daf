"""Licence texts by canonical digest.

A text is brought to a canonical form: lower case, without statements of a
copyright, equivalent spellings made one, punctuation and white space single
spaces, so that its wrapping does not matter.  Its SHA-256 is looked up among those of known licences by a hash
join.  Whole documents are looked up, and each of their lines by itself, since
licence notices mostly are one line of a longer document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm.common import ROW_ID, let, row_id

# Whole texts of short licences and common notices of others.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_CLAUSES = ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:""", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.""", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
                """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""")


def _bsd(clauses: int, mark: str) -> str:
    return "\n\n".join([_BSD_CLAUSES[0], *[mark.format(k) + _BSD_CLAUSES[k] for k in range(1, clauses + 1)], _BSD_WARRANTY])


ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = [
    ("MIT", MIT), ("MIT", "The MIT License\n\n" + MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    *[(f"BSD-{n}-Clause", title + _bsd(n, mark)) for n in (2, 3) for mark in ("{}. ", "* ")
      for title in ("", f"BSD {n}-Clause License\n\n", f"The BSD {n}-Clause License\n\n")],
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Zlib", "The zlib License\n\n" + ZLIB),
    *[("Unlicense", title + UNLICENSE + end) for title in ("", "The Unlicense\n\n")
      for end in ("", "\n\nFor more information, please refer to <https://unlicense.org>",
                  "\n\nFor more information, please refer to <https://unlicense.org/>")],
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# Equivalent spellings, as words between spaces, first to second.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("favour", "favor"),
    ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("organisation", "organization"), ("recognise", "recognize"),
    ("v2", "version 2"), ("v3", "version 3"), ("and or", "or"), ("http", "https"),
]
# A statement of a copyright: the word or (c) with a sign or year, in lower case; list items "(c)" are none.
STATEMENT = r"(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[<\[{](?:year|yyyy))|\(c\)[ \t]*[0-9]{4}|©)"
# How the texts of licences begin: a statement on the same line ends there.
OPENING = r"\b(?:permission is hereby granted|permission to use|redistribution and use|this software is provided|this is free and unencumbered)"
HOLDERS = 200  # a statement within a line, before a licence's text, has at most so many characters
STATED, OPENED = "\u0001", "\u0002"  # marks; a text's own ones count as white space


def _without_statements(plain: Column) -> Column:
    """A text in lower case without the copyright statements that a line begins with, up to its end or to a licence's
    text, or that stand in a line before a licence's text; lines that only reserve all rights go too."""
    marked = F.regexp_replace(F.translate(plain, STATED + OPENED, "  "), STATEMENT, STATED + "$0")
    marked = F.regexp_replace(marked, OPENING, OPENED + "$0")
    rest = F.regexp_replace(marked, rf"(?m)^[ \t#*/;%!-]*+{STATED}[^\n{OPENED}]*+", "")
    rest = F.regexp_replace(rest, rf"{STATED}[^\n{OPENED}]{{0,{HOLDERS}}}+{OPENED}", " ")
    rest = F.regexp_replace(rest, r"(?m)^[ \t#*/;%!-]*+all rights reserved[ \t.]*+$", "")
    return F.when(plain.rlike(r"copyright|©|\(c\)|all rights"), rest).otherwise(plain)


def canonical(text: Column) -> Column:
    """The canonical form; null stays null.

    Copyright statements go first; then whatever is no letter or digit
    becomes one space; then the spellings are made one.
    """
    plain = let(F.lower(text), _without_statements)
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(plain)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for a null text or one that has nothing left."""
    return let(canonical(text), lambda plain: F.when(plain != "", F.sha2(plain, 256)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id): one row a digest, the smallest license_id where two share one."""
    rows = spark.createDataFrame(known or KNOWN, "license_id string, text string")
    return (rows.select("license_id", digest(F.col("text")).alias("digest")).filter("digest is not null")
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_digest, license_id, n_license_lines, line_licenses) for every row of ``docs`` (doc_id, text).

    license_id is that of the whole text, line_licenses the distinct ids of
    its lines, sorted and joined by commas; null and empty text_digest as in
    ``digest``.  Null texts have no lines.  Repeated rows get equal results;
    an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", *row_id())
    lines = (rows.select(*ROW_ID, F.posexplode(F.split("text", "\n")).alias("line", "words"))
             .select(*ROW_ID, "line", digest(F.col("words")).alias("digest")))
    by_doc = (lines.join(known, "digest").groupBy(*ROW_ID)
              .agg(F.count_distinct("line").alias("n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("ids")))
    whole = rows.select("doc_id", *ROW_ID, digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    return (whole.join(by_doc, ROW_ID, "left")
            .select("doc_id", F.col("digest").alias("text_digest"), "license_id",
                    F.coalesce("n", F.lit(0).cast("long")).alias("n_license_lines"),
                    F.coalesce("ids", F.lit("")).alias("line_licenses")))
