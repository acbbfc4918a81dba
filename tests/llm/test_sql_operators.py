"""Operators with an SQL form: against DuckDB, and on awkward rows."""

import math
import textwrap

import duckdb
import pytest
from oracle import connect, compare
from pyspark.sql import functions as F

from millrace.llm import licences, line_dedup, mixing, queries, url_filter


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    compare(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name])


def _kept(texts, min_docs=3):
    up = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda x: x.translate(up).strip(" \t\n\x0b\x0c\r")
    where = {}
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(where.get(key(x), ())) >= min_docs and i != max(where[key(x)])
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in texts}


def test_line_dedup_rows(spark, docs_of):
    a, b = "this very line is repeated often", "another line that is seen again"
    texts = [(i, f"{a}\nown line number {i} of this text\n{b.upper() if i % 2 else b}  \n{a}") for i in range(6)] + [(6, None), (7, ""), (8, f"{a}\n"), (9, "\n\n")]
    docs = docs_of(texts)
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns and got.filter("n_dropped = 'x'").count() == 10
    want = _kept(texts)
    assert {r.doc_id: r.text or "" for r in got.collect()} == want
    out = {r.doc_id: r for r in line_dedup.op1(docs).collect()}
    assert (out[6].n_lines, out[7].n_lines, out[9].n_lines, out[0].n_dropped) == (1, 1, 3, 3)


def test_line_dedup_odd(odd):
    assert line_dedup.line_dedup(odd).count() == odd.count()
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0
    assert line_dedup.op1(odd).count() == odd.count()


def test_runs_are_a_bitmap(docs_of):
    line = "a line that is long enough to count"
    docs = docs_of([f"{line} 1\n{line} 2\nshort\n{line} 3\nmine {i} {line}" for i in range(3)])
    runs = {r.doc_id: [tuple(x) for x in r.drop_runs] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert runs == {0: [(0, 2), (3, 1)], 1: [(0, 2), (3, 1)]}


def test_mixing(spark, docs_of, odd):
    docs = docs_of(["t"] * 4000)
    got = mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, budget=8000)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["s0"] == pytest.approx(6000, rel=0.05) and n["s1"] == pytest.approx(2000, rel=0.08)
    assert got.filter("rate = 'x'").count() == sum(n.values())
    keys = [[r["shuffle_key"] for r in p] for p in got.select("shuffle_key").rdd.glom().collect()]
    flat = [k for p in keys for k in p]
    assert all(p == sorted(p) for p in keys) and len(set(flat)) == len(flat)
    assert mixing.mix(docs, {"s0": 1.0}).filter("source = 's1'").count() == 0
    assert mixing.mix(odd).count() > 0 and mixing.mix(odd.limit(0)).count() == 0


def _quantile(rate, u):
    k, cdf = 0, math.exp(-rate)
    while cdf < u:
        k += 1
        cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_large_rates(spark, docs_of):
    rates, us = [0.5, 499.5, 500.5, 700.0, 800.0, 1230.0, 20_000.0], [1e-9, 0.001, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(r, u) for r in rates for u in us], "r double, x double")
    got = rows.select("r", "x", mixing.poisson_quantile(mixing.poisson_table(F.col("r")), F.col("x")).alias("k")).collect()
    assert {(g.r, g.x): g.k for g in got} == {(r, u): _quantile(r, u) for r in rates for u in us}
    docs = docs_of(["t"] * 200).filter("source = 's0'")
    n = [r["count"] for r in mixing.mix(docs, {"s0": 1.0}, budget=120_000, shuffle=False).groupBy("doc_id").count().collect()]
    assert len(n) == 100 and len(set(n)) > 30 and sum(n) / 100 == pytest.approx(1200, rel=0.01)


def test_rates_have_the_right_mean_and_variance(spark):
    for rate, n in ((0.01, 4000), (700.0, 4000), (999.0, 2000), (1e5, 200)):
        one = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t"))
        draw = spark.range(n).crossJoin(F.broadcast(one)).select(mixing.poisson_quantile(F.col("t"), mixing.uniform("t", F.col("id"))).alias("k"))
        r = draw.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
        assert r["m"] == pytest.approx(rate, abs=5 * math.sqrt(rate / n)) and r["v"] == pytest.approx(rate, rel=0.15 if n > 1000 else 0.5, abs=0.01)


def test_a_source_of_one_document(spark, con, tmp_path):
    """One document beside a large source has a rate of hundreds: the SQL form draws the same copies."""
    import pandas as pd
    from oracle import connect

    rows = 400_000
    big = pd.DataFrame({"doc_id": range(rows), "text": "t", "lang": "en", "source": ["one"] + ["s"] * (rows - 1), "n_chars": 1})
    big.to_parquet(tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rate = mixing.source_rates(docs).filter("source = 'one'").first()["rate"]
    copies = mixing.mix(docs).filter("source = 'one'").count()
    assert rate > 600 and abs(copies - rate) < 5 * math.sqrt(rate)
    db = connect("/root/testdata/sf0.001")
    db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    assert db.execute(f"SELECT count(*) FROM ({mixing.ORACLE_SQL}) WHERE source = 'one'").fetchone()[0] == copies


def test_null_source_has_its_own_weight(spark):
    rows = [(i, "t", "null" if i % 2 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["count"] for r in mixing.mix(docs, {"null": 1.0, None: 3.0}).groupBy("source").count().collect()}
    assert got["null"] == pytest.approx(500, rel=0.2) and got[None] == pytest.approx(1500, rel=0.2)
    assert mixing.mix(docs, {"null": 1.0}).filter("source IS NULL").count() == 0


#: Names that operators use for what they compute beside the rows.
INTERNAL = ("doc", "draw", "rate", "salt", "own", "n", "copy_no", "shuffle_key", "__rate", "__source", "__u", "__n", "__own", "__salt", "__runs", "__id", "__t",
            "id", "t", "tid", "runs", "mark", "row", "kept_text", "n_lines", "n_dropped", "text_id", "digest", "__row", "__d", "__s", "key", "h", "bits", "__h")


def test_columns_of_internal_names_pass_through(spark):
    texts = ["one line that is repeated everywhere\nmine %d" % i for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"v-{c}").alias(c) for c in INTERNAL])
    same = lambda out, gone=(): all(r[c] == f"v-{c}" for r in out.collect() for c in INTERNAL if c not in gone)
    kept = line_dedup.line_dedup(docs)
    assert kept.columns == docs.columns and same(kept) and kept.filter("text LIKE 'one%'").count() == 1
    marked = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert same(marked, ("n_lines", "n_dropped", "kept_text")) and marked.agg(F.sum("n_dropped")).first()[0] == 4
    assert same(mixing.mix(docs), ("copy_no", "shuffle_key")) and mixing.mix(docs).count() > 0
    assert licences.licence_scan(docs).count() == 5 and line_dedup.op1(docs).count() == 5


def test_salted_rates_agree(docs_of, monkeypatch):
    docs = docs_of(["t"] * 300)
    want = sorted((r.doc_id, r.copy_no) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.copy_no) for r in mixing.mix(docs).collect()) == want


def test_licences(docs_of, odd):
    mit = licences.KNOWN[0][1]
    docs = docs_of([f"Copyright (c) 2020 A. Person\n{mit.upper()}", f"intro {mit}", "Fine text. Released under the MIT Licence. More.", None])
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    assert got[0].text_licences == ["MIT"] and got[1].text_licences == []
    assert got[2].notice_licences == ["MIT"] and got[2].n_notices == 1
    assert got[3].text_licences == got[3].notice_licences == []
    assert licences.licence_scan(odd).count() == odd.count() and licences.licence_scan(odd.limit(0)).count() == 0


def test_rewrapped_licences(spark, docs_of):
    whole = {k: body for k, body in reversed((*licences.KNOWN, *licences.WHOLE)) if "\n" in body}
    want, texts = [], []
    for k, body in whole.items():
        for width in (40, 60, 72, 78, 79, 80, 100, 120, 10**6):
            for head in ("", "Copyright (c) 2020 A. Person\n\n", f"{licences.TITLES[k][0]}\n\nCopyright 2020, A. Person\nAll rights reserved.\n\n", f"{licences.TITLES[k][1]}\n\nCopyright A. Person\n"):
                want.append(k)
                texts.append(head + textwrap.fill(" ".join(body.split()), width))
    got = {r.doc_id: r.text_licences for r in licences.licence_scan(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(want))] == [[k] for k in want]
    cut = whole["MIT"].replace("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR\n", "")
    assert licences.licence_scan(docs_of([cut])).first().text_licences == []


def test_tags_and_file_headers(docs_of):
    texts = ["# SPDX-License-Identifier: Apache-2.0\nimport os", "/* spdx-license-identifier: GPL-3.0-or-later */", "SPDX-License-Identifier: MIT OR other",
             '// Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\ncode()']
    got = {r.doc_id: (r.notice_licences, r.text_licences) for r in licences.licence_scan(docs_of(texts)).collect()}
    assert [got[i][0] for i in range(4)] == [["Apache-2.0"], ["GPL-3.0"], [], ["Apache-2.0"]] and got[1][1] == ["GPL-3.0"]


LAYOUTS = [
    ("GPL-3.0", lambda: textwrap.fill(_long_notice("GPL-3.0"), 70)),
    ("GPL-3.0", lambda: "/*\n" + "\n".join(f" * {x}" for x in textwrap.fill(_long_notice("GPL-3.0"), 50).split("\n")) + "\n */\nint x;"),
    ("Apache-2.0", lambda: "#!/bin/sh\n# Copyright 2020 A. Person\n#\n" + "\n".join(f"# {x}" for x in textwrap.fill(_long_notice("Apache-2.0"), 60).split("\n")) + "\n# You may obtain a copy\nset -e"),
    ("MIT", lambda: "# Project\n\nWhat it does.\n\n## Licence\n\nThe MIT License\n\nCopyright (c) 2020 A. Person\n\n" + textwrap.fill(licences.KNOWN[0][1].replace("\n", " "), 66) + "\n\nThanks."),
    ("MIT", lambda: "This project is licensed under the MIT License."),
    ("MIT", lambda: "Some words. This\nproject is licenced\nunder the MIT License. More words"),
]


def _long_notice(k):
    return max((body for i, body in licences.KNOWN if i == k), key=len)


def test_layouts_of_notices(spark, docs_of, tmp_path):
    import pandas as pd

    docs = docs_of([make() for _, make in LAYOUTS] + ["This project is licensed", "This program is free software.\n\nNo more", None, "\x01. \x01\n\n"])
    got = {r.doc_id: r for r in licences.op9(docs).collect()}
    assert [got[i].notice_licences for i in range(len(LAYOUTS))] == [k for k, _ in LAYOUTS]
    assert all(got[i].n_notices == 0 for i in range(len(LAYOUTS), len(LAYOUTS) + 4))
    pd.DataFrame([(r.doc_id, r.text) for r in docs.collect()], columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    compare(licences.op9(docs), con, licences.oracle_sql())
    assert licences.op9(docs.limit(0)).count() == 0


def test_long_licences(docs_of):
    known = licences.known_texts()
    long = [(k, b) for k, b in known if len(b) > 5000]
    assert {k for k, _ in long} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    wrap = lambda b, n: "\n\n".join(p if "opyright (" in p or "opyright [" in p else textwrap.fill(" ".join(p.split()), n) for p in b.split("\n\n"))
    texts = [b if n is None else wrap(b, n) for _, b in long for n in (None, 60, 100)]
    got = {r.doc_id: r.text_licences for r in licences.licence_scan(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [[k] for k, _ in long for _ in range(3)]


def test_url_filter(spark):
    urls = ["https://A.Example.org/es/x", "http://example.org/en/12", "http://example.org", "http://org/", "http://notorg/", "https://x.com/de/", "https://x.com/frx", None, "no scheme", "http://www.cheap-pills.net/", "a://b://c/d?e#f", "http://pillsbury.net/"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id int, url string, host string, other string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert [got[i].rule for i in range(12)] == ["example.org/es/", "example.org/en/1", None, "org/", None, "com/de/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(12)] == ["block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert (got[10].host, got[10].path, got[7].host) == ("b:", "//c/d", "")
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    assert url_filter.url_filter(pages.unionAll(pages)).count() == 24


def test_url_filter_clashes_and_long_urls(spark):
    long = "http://example.org/en/1" + "a/" * 200_000
    pages = spark.createDataFrame([(1, long), (2, ""), (3, "http://" + "x." * 50_000 + "com/de/y"), (4, "http://a.org/"), (4, "http://a.org/")], "page_id int, url string")
    names = ("host", "path", "rule", "verdict", "page", "token", "n", "level", "w")
    out = url_filter.url_filter(pages.select("*", *[F.lit(f"v-{c}").alias(c) for c in names]))
    got = {r.page_id: r for r in out.collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "block", "allow"] and out.count() == 5
    assert all(r[c] == f"v-{c}" for r in out.collect() for c in names[4:])


def test_sentences_that_start_like_no_known_text_cannot_be_one(spark):
    """The look at the first word loses nothing: known sentences in other spellings, cases and layouts."""
    texts = ["LICENCED   under the mit licence", "...(Released) under the MIT License", "this work is Licensed under the GNU General Public Licence, version 3", "Licensed under CC-BY 4.0", "copyright me", "", "Unlicensed"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    digests = licences.known_digests(spark)
    may = licences._may_be_known(F.col("text"), digests, 100)
    rows = docs.select("doc_id", may.alias("may"), F.sha2(licences.canonical(F.col("text")), 256).alias("digest")).join(digests.select("digest", "licence"), "digest", "left").collect()
    assert all(r.may for r in rows if r.licence) and {r.doc_id for r in rows if r.licence} == {0, 1, 2, 3}
    assert not any(r.may for r in rows if r.doc_id in (4, 5, 6))


def test_rules_without_tokens_are_kept(spark):
    pages = spark.createDataFrame([(1, "http://x.y/abc")], "page_id int, url string")
    rule = url_filter.Rule("block", pattern="ab+c$")
    assert url_filter.judge(pages.select(F.lit("x.y").alias("host"), F.lit("/abc").alias("path")), [rule]).count() == 1
