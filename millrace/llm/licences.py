"""Licence scan by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form (lower case, copyright lines removed, equivalent spellings unified, punctuation
and layout reduced to single spaces) and the digest of the *entire* canonical text is hash-joined to the digests of
known licences. The same lookup runs on three kinds of entire text: the whole document, each of its lines' sentences as
a notice of its own (a short notice such as a one-line grant is a complete text, just embedded in another), and windows of
its units. Units are sentences and paragraphs with comment marks removed and lines joined, so a notice may be wrapped at any
column or stand in the comment of a source file, and a whole licence may stand below a heading. A window starts at a unit whose
first words are a known text's and runs for as many units as that text has; one of a single line is a sentence already.

The table of known texts is a parameter; ``known_texts`` gives the grants and notices built in. It is small by
construction, and it is broadcast only after a check of its size (``BROADCAST_ROWS``); a larger one is joined by hash.
A sentence is only brought to canonical form if it starts with a word that some known text, or a spelling of it, starts
with: no other can be equal to one.

Defined results: null or empty texts match nothing; an empty table gives an empty result; repeated rows, equal ids and null ids
are reported once each; a notice that occurs twice counts twice in ``n_notices``, and a whole text below its title counts with
and without it; when several licences share one canonical text all are reported; a very long text is one row of its units;
columns beyond id and text play no part.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.keys import once

BROADCAST_ROWS = 10_000

#: (licence id, text). Public licence texts and customary notices, which must match word for word.
KNOWN = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    *(
        (
            f"GPL-{n}.0",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            f"published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.",
        )
        for n in (2, 3)
    ),
)
#: Names that a sentence gives a licence by, and how such a sentence begins.
NAMES = {
    "MIT": ("the MIT License", "the MIT license", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPLv3"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"),
    "ISC": ("the ISC License",),
    "Unlicense": ("the Unlicense",),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
}
SUBJECTS = ("", *(f"{this} {it} is " for this in ("this", "the") for it in ("project", "software", "work", "code", "library", "package", "program", "repository", "file")))
GRANTED = ("licensed under", "released under", "distributed under")

#: Tags that name a licence in one line, by the identifiers of the public list; fixed values.
TAGGED = (
    "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "BSL-1.0",
)

BSD_1_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Further whole licences. Lists are known with numbers and with other marks; ``licence_texts`` holds the long ones.
WHOLE = (
    *(("BSD-2-Clause", BSD_1_2.format(*n) + BSD_END) for n in (("1. ", "2. "), ("* ", "* "))),
    *(("BSD-3-Clause", BSD_1_2.format(*n) + BSD_3.format(n[2]) + BSD_END) for n in (("1. ", "2. ", "3. "), ("* ", "* ", "* "))),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    *(
        (
            "Unlicense",
            f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <{at}>""",
        )
        for at in ("https://unlicense.org", "http://unlicense.org/")
    ),
)
#: Title lines that files put above a whole text which does not carry its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Words that follow 'copyright', or the list mark '(c)', in the wording of licences rather than in a notice.
WORDING = (
    r"holders?|owners?|notices?|laws?|licen[cs]e[sd]?|interests?|statements?|permissions?|protection|doctrines?|status|treat(?:y|ies)|disclaimers?"
    r"|claims?|rights?|ownership|infringements?|and|or|in|is|are|on|to|for|of|as|that|this|which|under|with|such|if|by applicable|the (?:software|library|program|work)"
)
LISTED = WORDING + r"|you|the|a|an|any|if|all|must|each|no|it|its|whether|where|when|use|distribute|modify|make|sell|provide|reproduce|shall|may|not|every|only"
#: Notices carry names and years and are never part of a licence's wording: 'copyright' or '(c)' with a sign, a year, a
#: blank to fill in or a holder. A line of the wording that happens to start with 'copyright holders' is none.
COPYRIGHT_LINE = (
    r"(?md)^[ \t]*(copyright[ \t]*[:,]?[ \t]*(\(c\)|©|\d|[\[<{])|copyright[ \t]+(?!(?:" + WORDING + r")\b)\p{L}"
    r"|\(c\)[ \t]*(?!(?:" + LISTED + r")\b)[\p{L}\d\[<{©]|©|all rights reserved)[^\n]*$"
)
#: Equivalent spellings, applied as whole words after lower-casing and removal of punctuation. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("version 2 0", "version 2"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
)


def canonical(text: Column) -> Column:
    """Canonical form of a text; null gives the empty string."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(c)


def known_texts() -> list[tuple[str, str]]:
    """All built-in (licence id, text) pairs: ``KNOWN``, ``WHOLE``, both below their titles, the tags, and the files."""
    files = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    # Apache-2.0 is as often given without its appendix; that starts on a line of its own.
    files += [(k, body[: body.index("APPENDIX:")]) for k, body in files if k == "Apache-2.0"]
    short = [(k, body) for k, body in (*KNOWN, *WHOLE) if "\n" in body]
    tags = [(k, f"SPDX-License-Identifier: {k}{end}") for k in TAGGED for end in (("", "-only", "-or-later") if "GPL" in k else ("",))]
    named = [(k, f"{it}{granted} {name}.") for k, names in NAMES.items() for name in names for it in SUBJECTS for granted in GRANTED]
    return [*KNOWN, *named, *WHOLE, *((k, f"{title}\n{body}") for k, body in short for title in TITLES[k]), *tags, *files]


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """``digest, licence, first``: one row per distinct pair, with the first word of the canonical text."""
    known = known_texts() if known is None else known
    rows = spark.createDataFrame(list(known), "licence string, body string").select("licence", canonical(F.col("body")).alias("c"))
    return rows.select(F.sha2("c", 256).alias("digest"), "licence", F.split("c", " ")[0].alias("first")).distinct()


def _may_be_known(sentence: Column, digests: DataFrame, n: int) -> Column:
    """Whether a sentence starts with a known text's first word in any of its spellings."""
    if n > BROADCAST_ROWS:
        return F.lit(True)
    words = {r["first"] for r in digests.select("first").distinct().collect()}  # n words at most
    words |= {old.split()[0] for old, new in SPELLINGS if new.split()[0] in words}
    return F.regexp_extract(F.lower(sentence), r"[\p{L}\p{N}]+", 0).isin(*sorted(words))


def _sized(digests: DataFrame, n: int) -> DataFrame:
    return F.broadcast(digests) if n <= BROADCAST_ROWS else digests


#: What a line of a comment begins or ends with, and where a unit ends. Both engines read these patterns alike.
COMMENT = r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*+|//+!?|#+|--+|;+|%+|<!--+|\.\.|>)[ \t]*|[ \t]*(?:\*+/|--+>)[ \t]*$"
UNIT_END = r"([.!?])[ \t\r\n]+|\r?\n(?:[ \t]*\r?\n)+"
HEAD = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,2})"
MARK = "\x01"


def units(text: Column) -> Column:
    """The sentences and paragraphs of a text, without comment marks and notices; those without a word are left out."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, ""), COPYRIGHT_LINE, "")
    return F.filter(F.split(F.regexp_replace(plain, UNIT_END, "$1" + MARK), MARK), lambda u: u.rlike(r"[\p{L}\p{N}]"))


def head(unit: Column) -> Column:
    """The first three words of a unit, lower-cased."""
    return F.regexp_replace(F.lower(F.regexp_extract(unit, HEAD, 1)), r"[^\p{L}\p{N}]+", " ")


def _heads(known: DataFrame) -> dict[str, list[int]]:
    """For the first words of every known text (``licence, body``), in each spelling: how many units such texts have."""
    cut = known.select(units(F.col("body")).alias("u")).filter(F.size("u") > 0).select(head(F.col("u")[0]).alias("head"), F.size("u").alias("n"))
    out: dict[str, set[int]] = {}
    for r in cut.distinct().collect():  # a row for each known text at most
        spelt = [r["head"], *(r["head"].replace(new, old) for old, new in SPELLINGS if new in r["head"])]
        for h in spelt:
            out.setdefault(h, set()).add(r["n"])
    return {h: sorted(n) for h, n in sorted(out.items())}


def windows(u: Column, heads: Column, known: dict[str, list[int]]) -> Column:
    """From the units of a text and their first words: texts of more than one line that start like a known text and have as many
    units."""
    sizes = F.create_map(*[x for h, n in known.items() for x in (F.lit(h), F.array(*map(F.lit, n)))])
    starts = F.filter(F.transform(heads, lambda h, i: F.when(h.isin(*known), i + 1)), lambda i: i.isNotNull())
    run = lambda i, n: F.when(i + n - 1 <= F.size(u), F.array_join(F.slice(u, i, n), "\n"))
    found = F.flatten(F.transform(starts, lambda i: F.transform(F.element_at(sizes, F.element_at(heads, i)), lambda n: run(i, n))))
    return F.coalesce(F.filter(found, lambda w: w.contains("\n")), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """The notices of a text: its pieces between line ends or a closing mark followed by a blank."""
    return F.split(F.coalesce(text, F.lit("")), r"\n+|[.!?]+[ \t]+", -1)


def licence_scan(docs: DataFrame, known=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id>, digest, text_licences, notice_licences, n_notices``.

    ``text_licences`` names the licences whose whole wording is the whole document, ``notice_licences`` those whose
    wording is a whole sentence or window of it (both sorted arrays, empty if none).
    """
    spark = docs.sparkSession
    known = known_texts() if known is None else known
    digests, n = known_digests(spark, known), len(known)
    by_digest = digests.groupBy("digest").agg(F.array_sort(F.collect_set("licence")).alias("licences"))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("row", F.monotonically_increasing_id())
    whole = base.withColumn("digest", F.sha2(canonical(F.col("t")), 256))
    whole = whole.join(_sized(by_digest, n), "digest", "left").withColumnRenamed("licences", "text_licences")
    heads = _heads(spark.createDataFrame(list(known), "licence string, body string"))
    if heads:  # each computed once a row: the lambdas below read them again and again
        whole = whole.withColumn("u", once(units(F.col("t")))).withColumn("heads", once(F.transform("u", head)))
    more = windows(F.col("u"), F.col("heads"), heads) if heads else F.array().cast("array<string>")
    s = whole.select("id", "row", "digest", "text_licences", F.explode(F.concat(sentences(F.col("t")), more)).alias("s"))
    own = F.when(_may_be_known(F.col("s"), digests, n), F.sha2(canonical(F.col("s")), 256))
    hit = s.withColumn("d", own).join(_sized(by_digest.select(F.col("digest").alias("d"), "licences"), n), "d", "left")
    empty = F.array().cast("array<string>")
    return (
        hit.groupBy("row")
        .agg(
            F.first("id").alias(id_col),
            F.first("digest").alias("digest"),
            F.coalesce(F.first("text_licences"), empty).alias("text_licences"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("licences")))).alias("notice_licences"),
            F.count("licences").alias("n_notices"),
        )
        .drop("row")
    )


def op9(docs: DataFrame) -> DataFrame:
    """Digest columns: arrays joined by commas, so that any engine can compare them."""
    out = licence_scan(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "digest",
        F.array_join("text_licences", ",").alias("text_licences"),
        F.array_join("notice_licences", ",").alias("notice_licences"),
        "n_notices",
    )


#: A notice line in SQL: the engine has no look-ahead, so each form that needs one is a match and a match that must not be.
SQL_NOTICES = (
    (r"^[ \t]*(copyright[ \t]*[:,]?[ \t]*(\(c\)|©|\d|[\[<{])|©|all rights reserved)", None),
    (r"^[ \t]*copyright[ \t]+\p{L}", rf"^[ \t]*copyright[ \t]+(?:{WORDING})\b"),
    (r"^[ \t]*\(c\)[ \t]*[\p{L}\d\[<{©]", rf"^[ \t]*\(c\)[ \t]*(?:{LISTED})\b"),
)


def _sql_canonical(x: str) -> str:
    hit = lambda r: f"regexp_matches(l, '{r}')"
    notice = " OR ".join(f"({hit(yes)} AND NOT {hit(no)})" if no else hit(yes) for yes, no in SQL_NOTICES)
    c = f"array_to_string(list_filter(string_split(lower(coalesce({x}, '')), chr(10)), lambda l: NOT ({notice})), chr(10))"
    c = f"' ' || trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        c = f"replace({c}, ' {old} ', ' {new} ')"
    return f"trim({c})"


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    hit = lambda r: f"regexp_matches(l, '{r}')"
    notice = " OR ".join(f"({hit(yes)} AND NOT {hit(no)})" if no else hit(yes) for yes, no in SQL_NOTICES)
    lines = lambda x: f"array_to_string(list_transform(string_split({x}, chr(10)), lambda o: CASE WHEN list_bool_or([({notice}) for l in [lower(o)]]) THEN '' ELSE o END), chr(10))"
    plain = lambda x: lines(f"regexp_replace(coalesce({x}, ''), '{COMMENT}', '', 'g')")
    units = lambda x: rf"list_filter(string_split(regexp_replace({plain(x)}, '{UNIT_END}', '\1' || chr(1), 'g'), chr(1)), lambda u: regexp_matches(u, '[\p{{L}}\p{{N}}]'))"
    head = rf"regexp_replace(regexp_extract(lower(u[i]), '{HEAD}', 1), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    spelt = "list_concat([h], list_transform(list_filter([{}], lambda p: contains(h, p.b)), lambda p: replace(h, p.b, p.a)))".format(", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in SPELLINGS))
    return f"""
WITH known(licence, body) AS (VALUES {values}),
k AS (SELECT DISTINCT licence, sha256({_sql_canonical('body')}) AS digest FROM known),
f AS (SELECT DISTINCT unnest({spelt}) AS head, n FROM (SELECT {head} AS h, len(u) AS n FROM (SELECT {units('body')} AS u, 1 AS i FROM known) WHERE len(u) > 0)),
d AS (SELECT doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents),
u AS (SELECT doc_id, {units('text')} AS u FROM documents),
p AS (SELECT doc_id, u, i, {head} AS head FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM u)),
x AS (SELECT doc_id, array_to_string(u[i : i + n - 1], chr(10)) AS body FROM p JOIN f USING (head) WHERE i + n - 1 <= len(u)),
s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n+|[.!?]+[ \\t]+')) AS body FROM documents
      UNION ALL SELECT doc_id, body FROM x WHERE contains(body, chr(10))),
h AS (SELECT doc_id, sha256({_sql_canonical('body')}) AS digest FROM s),
n AS (SELECT h.doc_id, array_to_string(list_sort(list(DISTINCT k.licence)), ',') AS notice_licences,
             count(DISTINCT row) AS n_notices FROM (SELECT *, row_number() OVER () AS row FROM h) h JOIN k USING (digest) GROUP BY h.doc_id),
w AS (SELECT d.doc_id, array_to_string(list_sort(list(DISTINCT k.licence)), ',') AS text_licences
      FROM d JOIN k USING (digest) GROUP BY d.doc_id)
SELECT d.doc_id, d.digest, coalesce(text_licences, '') AS text_licences, coalesce(notice_licences, '') AS notice_licences,
       coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN w USING (doc_id)
""".replace("\\\\", "\\")
