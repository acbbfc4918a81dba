"""Files, streams and tool surfaces as queries (what is written is read back), and the operators' parts as entries of their own."""

from __future__ import annotations

import uuid
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import chunks as K
from millrace.operators import asking, core, ledger, segments, sqlguard, vectors
from millrace.operators import retrieval as R
from millrace.operators.tools import Registry
from millrace.plans.analytics import GAPPY, gappy
from millrace.plans.base import Catalogue
from millrace.plans.relational import TRADES, trades
from millrace.plans.texts import BEST, BM25, DENSE, FIRST, HYBRID, ITEMS, REL, STATED, TOP, dense_best, dense_top, lexical, relevant, rounded, stated_vectors, with_documents
from millrace.session import arrow_map, scratch_root, swept
from millrace.sources import documents, feeds, sinks, tables
from millrace.streaming import keyed, streams

C = Catalogue()
add = C.add


def folder(t, name: str) -> str:
    """A new folder of the shared scratch area, which goes when the driver exits."""
    swept(t.spark)
    return f"{scratch_root(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_folder(t, name: str) -> str:
    """A new folder of the shared scratch area as a path that a database driver opens: it is mounted alike everywhere."""
    path = folder(t, name).removeprefix("file://").removeprefix("file:")
    Path(path).mkdir(parents=True)
    return path


def finished(query) -> None:
    query.awaitTermination()


# --- readers --------------------------------------------------------------------------------------------------------


@add("src2_market_snapshot", "SELECT strftime(o_orderdate, '%Y-%m') AS date, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-01' GROUP BY 1")
def _(t):
    """A stored JSON document by its date, decoded."""
    stored = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))).alias("data"))
    return stored.filter("date = '1996-01'").select("date", F.from_json("data", "n long, total double").alias("d")).select("date", "d.*")


PART = ("p_partkey", "p_brand", "p_size", "p_retailprice")


@add("src4_csv_inferred", f"SELECT {', '.join(PART)} FROM part")
def _(t):
    sinks.write_csv(t.part.select(*PART), path := folder(t, "csv"))
    return tables.read_csv(t.spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), *PART[1:])


@add("src6_csv_or_empty", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    sinks.write_csv(t.nation.select("n_nationkey", "n_name"), path := folder(t, "csv"))
    schema = "n_nationkey int, n_name string"
    return tables.read_csv(t.spark, path, schema).unionByName(tables.read_csv(t.spark, folder(t, "none"), schema, missing_ok=True))


@add("src7_json_document", "SELECT r_regionkey, r_name FROM region")
def _(t):
    """One document that is an array; a file that is not there gives no rows."""
    whole = t.region.agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    whole.coalesce(1).write.text(path := folder(t, "json"))
    schema = "r_regionkey int, r_name string"
    return tables.read_json(t.spark, path, schema).unionByName(tables.read_json(t.spark, folder(t, "none"), schema, missing_ok=True))


@add("src8_json_lines", "SELECT c_custkey, c_name FROM customer")
def _(t):
    lines = t.customer.select(F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    lines.unionByName(t.region.select(F.lit('{"c_custkey": broken').alias("value"))).write.text(path := folder(t, "lines"))
    return tables.read_json(t.spark, path, "c_custkey long, c_name string", multi_line=False)


@add("src9_json_tree", "SELECT s_suppkey, s_name, s_nationkey AS place FROM supplier")
def _(t):
    """A document in each folder of a tree, with the folder that a row came from."""
    docs = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value"))
    docs.select("value", F.col("s_nationkey").alias("place")).write.partitionBy("place").text(path := folder(t, "tree"))
    rows = tables.read_tree(t.spark, path, "*.txt", "s_suppkey long, s_name string")
    return rows.select("s_suppkey", "s_name", F.regexp_extract("source_file", r"place=(\d+)", 1).cast("int").alias("place"))


@add("src10_sheet_coerced", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS balance, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS nation FROM supplier")
def _(t):
    sheet = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("s_suppkey"), F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("balance"),
        F.when(F.col("s_suppkey") % 3 == 0, "?").otherwise(F.col("s_nationkey").cast("string")).alias("nation"))
    sinks.write_csv(sheet, path := folder(t, "sheet"))
    return tables.coerced(tables.read_csv(t.spark, path, "s_suppkey string, balance string, nation string"), {"s_suppkey": "long", "balance": "double", "nation": "int"}, {"balance": 0.0})


BLOCKS = "b AS (SELECT p_partkey // 40 AS page, (p_size * 3 + p_partkey % 4)::DOUBLE AS y, (p_partkey % 40)::DOUBLE AS x, p_brand AS body FROM part)"
ROWS = f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x) AS n FROM b),
  f AS (SELECT *, 0 AS r, y AS top FROM o WHERE n = 1 UNION ALL SELECT o.*, CASE WHEN abs(o.y - f.top) <= 2 THEN f.r ELSE f.r + 1 END, CASE WHEN abs(o.y - f.top) <= 2 THEN f.top ELSE o.y END
  FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1)"""


def page_rows(t):
    blocks = t.part.select(F.expr("p_partkey div 40").alias("page"), (F.col("p_size") * 3 + F.col("p_partkey") % 4).alias("y"), (F.col("p_partkey") % 40).alias("x"), F.col("p_brand").alias("body"))
    return tables.page_rows(blocks, "page", tolerance=2.0)


@add("src11_page_lines", f"{ROWS} SELECT page, r AS row, string_agg(body, ' | ' ORDER BY x) AS line FROM f GROUP BY ALL")
def _(t):
    return page_rows(t)


@add("win10_gap_rows", f"{ROWS} SELECT page, max(r) + 1 AS rows FROM f GROUP BY ALL")
def _(t):
    return page_rows(t).groupBy("page").agg(F.count(F.lit(1)).alias("rows"))


@add("src12_docx", """SELECT n_nationkey, n_name || chr(10) || 'region ' || n_regionkey || chr(10) || chr(10) || '[Table 1]' || chr(10) || 'key | ' || n_nationkey AS body, NULL::VARCHAR AS error FROM nation
  UNION ALL SELECT -1, '', 'Error reading Word document'""")
def _(t):
    """A word-processor file for each nation is written, and parsed again; a broken file is reported."""

    def write(batches):
        for batch in batches:
            files = [documents.docx_file([name, "  ", f"region {region}"], [[["key", str(key)], ["", " "]]]) for key, name, region in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch.column(0).to_pylist()]), pa.array(files, pa.binary())], names=["path", "content"])

    files = arrow_map(t.nation.select("n_nationkey", "n_name", "n_regionkey"), write, "path string, content binary")
    broken = t.spark.createDataFrame([("-1", bytearray(b"no archive"))], "path string, content binary")
    parsed = documents.parse_docx(files.unionByName(broken))
    return parsed.select(F.col("path").cast("int").alias("n_nationkey"), "body", F.regexp_extract("error", "^[^:]*", 0).alias("error"))


@add("src13_captions", "SELECT conv_id, turn, printf('00:%02d:05.250', turn::INTEGER) AS start_time, printf('%02d:09.500', turn::INTEGER) AS end_time, role || ' said it' AS body FROM conversations")
def _(t):
    """Cues written and parsed again: hours may be missing, voices and blanks go."""
    cue = F.format_string("%d\n00:%02d:05.250 --> %02d:09.500 align:start\n<v %s>%s   said\n<i>it</i>", F.col("turn").cast("int"), F.col("turn").cast("int"), F.col("turn").cast("int"), F.col("role"), F.col("role"))
    files = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.collect_list(cue), "\n\n")).alias("text"))
    return tables.captions(files).select("conv_id", F.split("start_time", ":")[1].cast("long").alias("turn"), "start_time", "end_time", "body")


@add("src18_catalog", "SELECT * FROM (VALUES ('seen_nation', 'n_name', 'string'), ('seen_nation', 'n_nationkey', 'int'), ('seen_nation', 'n_regionkey', 'int')) v(\"table\", \"column\", \"type\")")
def _(t):
    t.nation.select("n_nationkey", "n_name", "n_regionkey").createOrReplaceTempView("seen_nation")
    return tables.catalog(t.spark).filter("`table` = 'seen_nation'")


@add("src21_server_events", "SELECT event_id, event_type AS event, event_id::VARCHAR AS id, props || chr(10) || 'more' AS data FROM events UNION ALL SELECT event_id, NULL, NULL, 'ping' FROM events")
def _(t):
    message = F.concat(F.lit("event: "), "event_type", F.lit("\nid: "), "event_id", F.lit("\ndata: "), "props", F.lit("\ndata: more\n\n: comment\n\ndata: ping\n\n"))
    return streams.server_events(t.events.select("event_id", message.alias("text")), "text")


@add("src21_event_stream", "SELECT event_id AS id, event_type AS event, props AS data FROM events")
def _(t):
    """Events as a feed that a stream reads, stops, and resumes once it has grown: none lost, none twice."""
    feeds.register(t.spark)
    root = folder(t, "feed")
    message = F.concat(F.lit("id: "), "event_id", F.lit("\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n"))
    stream = t.spark.readStream.format("event_feed").option("path", f"{root}/feed").load()
    for i, part in enumerate(("event_type = 'view'", "event_type <> 'view'")):
        t.events.filter(part).select(message.alias("value")).write.text(f"{root}/feed/{i:06d}")
        finished(stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out"))
    return t.spark.read.parquet(f"{root}/out")


@add("src16_insert_read_back", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    """Customers inserted into a database table by all tasks, committed at once, and read back in ranges."""
    feeds.register(t.spark)
    rows, to = t.customer.select("c_custkey", "c_name", "c_acctbal"), {"connection": f"{local_folder(t, 'db')}/rows.db", "table": "customer"}
    rows.write.format("dbapi").options(**to).mode("append").save()
    return t.spark.read.format("dbapi").options(**to).schema(rows.schema).load()


@add("src22_mock_prices", "SELECT 'ABC' AS symbol, 30 AS days, DATE '1998-07-04' AS first_day, true AS ordered, true AS repeatable")
def _(t):
    rows = tables.mock_prices(t.spark, "ABC", "1998-08-02")
    again = rows.exceptAll(tables.mock_prices(t.spark, "ABC", "1998-08-02")).agg(F.count(F.lit(1)).alias("n"))  # one row
    inside = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    facts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.every(inside).alias("ordered"))
    return facts.crossJoin(F.broadcast(again)).select("symbol", "days", "first_day", "ordered", (F.col("n") == 0).alias("repeatable"))


@add("src23_traces", "SELECT user_id % 3 AS part, event_id, event_type FROM events")
def _(t):
    """Span files of several runs, the last name first; a line that is not JSON is skipped."""
    root, parts = folder(t, "traces"), t.events.select(F.to_json(F.struct((F.col("user_id") % 3).alias("part"), "event_id", "event_type")).alias("value"), (F.col("user_id") % 3).alias("p"))
    parts.unionByName(t.spark.range(3).select(F.lit("not json").alias("value"), F.col("id").alias("p"))).write.partitionBy("p").text(root)
    rows = t.spark.read.schema("part long, event_id long, event_type string").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).json(root)
    return rows.orderBy(F.desc("part"), "event_id")


# --- write paths ----------------------------------------------------------------------------------------------------


@add("snk10_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    sinks.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path := folder(t, "csv"))
    return tables.read_csv(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@add("snk11_dual_write", "SELECT 'lines' AS sink, event_id, event_type FROM events UNION ALL SELECT 'table', event_id, event_type FROM events")
def _(t):
    """A stream written to JSON lines and to a table, both read again."""
    root = folder(t, "dual")
    rows = t.events.select("event_id", "event_type")
    rows.write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    finished(sinks.dual_write(stream, f"{root}/lines", f"{root}/table", f"{root}/c").trigger(availableNow=True).start())
    lines = tables.read_json(t.spark, f"{root}/lines", rows.schema, multi_line=False).select(F.lit("lines").alias("sink"), "*")
    return lines.unionByName(t.spark.read.parquet(f"{root}/table").select(F.lit("table").alias("sink"), "*"))


@add("snk12_vector_index", "SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings")
def _(t):
    sinks.write_index(t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding"), path := folder(t, "index"))
    return t.spark.read.parquet(path).select("id", "label", F.size("embedding").cast("long").alias("dim"))


@add("snk13_lexical_index", "SELECT doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM documents) WHERE term = 'the' GROUP BY 1")
def _(t):
    """Postings saved, and one term's read again from its bucket."""
    sinks.write_postings(R.postings(t.documents, "doc_id"), path := folder(t, "postings"))
    return t.spark.read.parquet(path).filter((F.col("bucket") == sinks.term_bucket(F.lit("the"))) & (F.col("term") == "the")).select("id", "tf")


@add("snk13_growing_index", "WITH " + BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)", 1) + f" SELECT query_id, id, round(score, 8) AS score, {TOP} AS rank FROM s WHERE score > 0 QUALIFY {TOP} <= 10")
def _(t):
    """An index of half of the documents, three appends of the others and one deletion: the ranks of an index built at once."""
    index = segments.SegmentIndex(t.spark, folder(t, "segments")).create()
    for part in ("doc_id % 2 = 0", "doc_id % 6 = 1", "doc_id % 6 = 3", "doc_id % 6 = 5"):
        index.append(t.documents.filter(part), "doc_id")
    index.delete(t.documents.filter("doc_id % 10 = 3"), "doc_id")
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.top(rounded(index.search(q, 10)), 10)


@add("snk14_append_row", "SELECT c_name AS name, 'first' AS notes FROM customer UNION ALL SELECT s_name, 'second' FROM supplier")
def _(t):
    path = folder(t, "rows")
    sinks.write_csv(t.customer.select(F.col("c_name").alias("name"), F.lit("first").alias("notes")), path, "append")
    sinks.write_csv(t.supplier.select(F.col("s_name").alias("name"), F.lit("second").alias("notes")), path, "append")
    return tables.read_csv(t.spark, path, "name string, notes string")


@add("udf13_atomic_update", "SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN -10 ELSE 10 END AS c_acctbal FROM customer")
def _(t):
    """Debit and credit committed as one; a second update fails in its last step and leaves the table as it is."""
    root = folder(t, "accounts")
    sinks.commit(t.customer.select("c_custkey", "c_acctbal"), root)
    moved = lambda rest, by: lambda d: d.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == rest, F.col("c_acctbal") + by).otherwise(F.col("c_acctbal")))
    sinks.atomic(t.spark, root, moved(0, -10), moved(1, 10))

    def refuse(_):
        raise ValueError("no such account")

    try:
        sinks.atomic(t.spark, root, moved(0, -1e9), refuse)
    except ValueError:
        pass  # the point of the query: nothing of it is seen
    return sinks.current(t.spark, root)


# --- parts of operators as entries of their own -----------------------------------------------------------------------


@add("prj12_chunk_metadata", """WITH w AS (SELECT doc_id, source, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)
  SELECT doc_id, source, lang, (s // 180)::INTEGER AS chunk_idx, len(ws[s + 1 : s + 200])::INTEGER AS n FROM (SELECT *, unnest(range(0, len(ws), 180)) AS s FROM w)""")
def _(t):
    c = K.word_windows(t.documents.select("doc_id", "source", "lang", "text"), size=200, overlap=20)
    return c.select("doc_id", "source", "lang", "chunk_idx", F.size(F.split("chunk", " ")).alias("n"))


@add("flt13_score_threshold", "WITH " + DENSE.format(which=STATED) + " SELECT query_id, id FROM v WHERE 1 - score < 0.9 AND score > 0")
def _(t):
    return rounded(vectors.above(*stated_vectors(t), 0.1)).filter((1 - F.col("score") < 0.9) & (F.col("score") > 0)).select("query_id", "id")


STATEMENTS = (
    ("SELECT n_name FROM guarded", True), ("WITH x AS (SELECT 1 AS a) SELECT a FROM x", True), ("SELECT ';' AS semicolon FROM guarded", True), ("DROP TABLE guarded", False),
    ("SELECT 1; DROP TABLE guarded", False), ("INSERT INTO guarded SELECT 1, 'x', 1", False), ("SELECT missing FROM guarded", False), ("UPDATE guarded SET n_name = 'x'", False), ("", False),
)


def verdicts(t):
    t.nation.createOrReplaceTempView("guarded")
    return t.spark.createDataFrame([(i, sqlguard.validate(t.spark, sql)[0]) for i, (sql, _) in enumerate(STATEMENTS)], "statement int, valid boolean")


_valid = "SELECT * FROM (VALUES {}) v(statement, valid)".format(", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(STATEMENTS)))


@add("udf8_validate", _valid)
def _(t):
    return verdicts(t)


@add("flt17_read_only", f"SELECT statement FROM ({_valid}) WHERE NOT valid")
def _(t):
    return verdicts(t).filter("NOT valid").select("statement")


@add("srt9_injected_limit", "SELECT 'none' AS own_limit, 100 AS n UNION ALL SELECT 'three', 3")
def _(t):
    t.customer.createOrReplaceTempView("many_rows")
    size = lambda name, sql: sqlguard.run(t.spark, sql).agg(F.lit(name).alias("own_limit"), F.count(F.lit(1)).alias("n"))
    return size("none", "SELECT * FROM many_rows").unionByName(size("three", "SELECT * FROM many_rows LIMIT 3"))


@add("srt3_argsort_topk", "SELECT vec_id, embedding[1]::DOUBLE AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 25")
def _(t):
    return t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("score")).orderBy(F.desc("score"), "vec_id").limit(25)


@add("srt7_overfetch", f"""WITH {DENSE.format(which=STATED)}, f AS (SELECT query_id, id, score FROM v QUALIFY {TOP} <= 30)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 7, id) AS rank FROM f QUALIFY rank <= 10""")
def _(t):
    """Three times as many as asked for by one score, the best of them by another."""
    first = dense_top(t, 30)
    return R.rerank(first, -(F.col("id") % 7).cast("double"), 10).select("query_id", "id", "rank")


@add("srt8_severity_order", """SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 999 END, ts DESC, event_id) AS place
  FROM events QUALIFY place <= 50""")
def _(t):
    rank = F.create_map(F.lit("error"), F.lit(0), F.lit("purchase"), F.lit(1), F.lit("click"), F.lit(2))
    top = t.events.orderBy(F.coalesce(rank[F.col("event_type")], F.lit(999)), F.desc("ts"), "event_id").limit(50)
    kept = top.select(F.col("event_id"), F.struct(F.coalesce(rank[F.col("event_type")], F.lit(999)).alias("r"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id").alias("o"))
    return kept.select("event_id", F.row_number().over(Window.orderBy("o")).alias("place"))  # 50 rows


PAIRS = "u AS (SELECT a.account, a.symbol, a.q AS quantity, p.avg_cost, p.price FROM h a JOIN c p ON a.symbol = p.symbol)"
COSTS = """h AS (SELECT account, symbol, sum(signed)::DECIMAL(18,0) AS q FROM trades GROUP BY ALL HAVING sum(signed) <> 0),
  c AS (SELECT p_partkey AS symbol, p_retailprice::DECIMAL(18,2) - 10 AS avg_cost, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice::DECIMAL(18,2) ELSE 0 END AS price FROM part)"""


def open_positions(t):
    cost = t.part.select(F.col("p_partkey").alias("s"), (F.col("p_retailprice").cast("decimal(18,2)") - 10).alias("avg_cost"))
    return ledger.holdings(trades(t)).join(cost, F.col("symbol") == F.col("s")).drop("s")


def quoted(t):
    return t.part.filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))


@add("mth13_unrealised", f"WITH {TRADES}, {COSTS}, {PAIRS} SELECT account, sum(quantity * price)::DOUBLE AS market_value, sum(quantity * (price - avg_cost))::DOUBLE AS unrealized FROM u GROUP BY 1")
def _(t):
    valued = ledger.unrealised(open_positions(t), quoted(t))
    return valued.groupBy("account").agg(F.sum("market_value").cast("double").alias("market_value"), F.sum("unrealized").cast("double").alias("unrealized"))


@add("jon2_missing_price", f"WITH {TRADES}, {COSTS}, {PAIRS} SELECT account, symbol, (quantity * (price - avg_cost))::DOUBLE AS unrealized FROM u WHERE symbol % 10 = 0")
def _(t):
    """Without a price all of the cost is lost."""
    return ledger.unrealised(open_positions(t), quoted(t)).filter("symbol % 10 = 0").select("account", "symbol", F.col("unrealized").cast("double").alias("unrealized"))


@add("jon5_id_lookup", f"WITH {BM25}, {FIRST.format(k=3)} SELECT query_id, r.id, rank, source, length(text) AS n FROM r JOIN documents ON doc_id = r.id")
def _(t):
    return with_documents(t, lexical(t, 3), "source", F.length("text").alias("n")).select("query_id", "id", "rank", "source", "n")


@add("jon8_rerank_pairs", f"WITH {BM25}, {FIRST.format(k=15)} SELECT query_id, id, length(b.text) + length(d.text) AS chars FROM r JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id")
def _(t):
    """Each query beside its candidates, which the first stage bounds."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = with_documents(t, lexical(t, 15), "text").join(core.small(q), "query_id")
    return pairs.select("query_id", "id", (F.length("query") + F.length("text")).alias("chars"))


@add("jon14_relevant_found", f"WITH {BM25}, {REL}, {FIRST.format(k=10)} SELECT r.query_id, r.id, rank FROM r SEMI JOIN rel ON rel.query_id = r.query_id AND rel.id = r.id")
def _(t):
    return lexical(t, 10).join(relevant(t).select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", "rank")


QUALITY = f"""WITH {BM25}, {REL}, {FIRST.format(k=5)}, g AS (SELECT rel.query_id, count(DISTINCT rel.id) AS n, min(r.rank) AS first, count(r.rank) AS hits, coalesce(sum(1 / log2(r.rank + 1)), 0) AS dcg
  FROM rel LEFT JOIN r ON rel.query_id = r.query_id AND rel.id = r.id GROUP BY 1)"""
for _key, _cols, _sql in (
    ("win11_reciprocal_rank", ("mrr",), "round(coalesce(1 / first, 0), 6) AS mrr"),
    ("win12_ndcg", ("ndcg",), "round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg"),
    ("mth11_precision_recall", ("precision", "recall"), "round(hits / 5, 6) AS precision, round(hits / n, 6) AS recall"),
):

    @add(_key, f"{QUALITY} SELECT query_id, {_sql} FROM g")
    def _(t, cols=_cols):
        q = R.quality(lexical(t, 5), relevant(t), 5)
        return q.select("query_id", *[F.round(c, 6).alias(c) for c in cols])


@add("mth7_fusion", f"WITH {BM25}, {DENSE.format(which=ITEMS)}, {HYBRID.replace('0.5 *', '0.25 *', 1).replace('0.5 *', '0.75 *', 1)} SELECT query_id, id, score FROM h QUALIFY {TOP} <= 10")
def _(t):
    both = R.hybrid(lexical(t, 20).drop("rank"), dense_best(t, 20).drop("rank"), 10, 0.25, 0.75)
    return both.select("query_id", "id", F.round("score", 8).alias("score"))


_stop = ", ".join("len(list_filter(ws, lambda w: w IN ({}))) AS {}_".format(", ".join(f"'{w}'" for w in ws), lang) for lang, ws in X.STOP_WORDS.items())
_most = " ".join(f"WHEN {lang}_ = top THEN '{lang}'" for lang in X.STOP_WORDS)


@add("str19_stop_word_language", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents), n AS (SELECT doc_id, {_stop} FROM w),
  t AS (SELECT *, greatest({', '.join(f'{lang}_' for lang in X.STOP_WORDS)}) AS top FROM n) SELECT doc_id, CASE WHEN top = 0 THEN 'und' {_most} END AS lang FROM t""")
def _(t):
    return t.documents.select("doc_id", X.stop_word_language(F.col("text")).alias("lang"))


@add("dat9_duration_ms", "SELECT event_id, round(((value * 1000000)::BIGINT) / 1000.0::DOUBLE, 2) AS ms FROM events")
def _(t):
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1_000_000).cast("long"))
    return t.events.select("event_id", D.duration_ms(start, end).alias("ms"))


@add("dat14_weekday_name", "SELECT event_id, dayname(ts) AS name FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "EEEE").alias("name"))


@add("dat18_epoch_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.epoch_iso(F.unix_timestamp("o_orderdate")).alias("iso"))


@add("nst6_repeat", "SELECT n_nationkey, repeat(n_name || ',', n_regionkey + 1) AS v FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.array_join(F.array_repeat(F.concat("n_name", F.lit(",")), F.col("n_regionkey") + 1), "").alias("v"))


@add("nst8_any_all", "SELECT conv_id, bool_or(role = 'user') AS has_user, bool_or(turn > 3) AS some_late, bool_and(turn < 100) AS all_early, NOT bool_or(role = 'nobody') AS none_nobody FROM conversations GROUP BY 1")
def _(t):
    role, turn = F.col("role"), F.col("turn")
    return t.conversations.groupBy("conv_id").agg(
        F.bool_or(role == "user").alias("has_user"), F.bool_or(turn > 3).alias("some_late"),
        F.bool_and(turn < 100).alias("all_early"), (~F.bool_or(role == "nobody")).alias("none_nobody"))


@add("agg43_cleaning_plan", f"""WITH {GAPPY}, n AS (SELECT count(*) AS n, count(DISTINCT p_partkey) AS a, count(DISTINCT p_size) AS b, count(DISTINCT p_brand) AS c, count(DISTINCT fixed) AS d FROM gappy),
  h AS (SELECT list_filter([CASE WHEN a > 50 OR a / n > 0.30 THEN 'p_partkey' END, CASE WHEN b > 50 OR b / n > 0.30 THEN 'p_size' END, CASE WHEN c > 50 OR c / n > 0.30 THEN 'p_brand' END], lambda x: x IS NOT NULL) AS cols FROM n)
  SELECT 1 AS place, 'Impute missing values' AS step UNION ALL SELECT 2, 'Remove constant columns: fixed' UNION ALL SELECT 3, 'Consider handling high cardinality columns: ' || array_to_string(cols, ', ') FROM h""")
def _(t):
    plan = core.cleaning_plan(core.audit(gappy(t)))
    return t.spark.createDataFrame([(i, step) for i, (step, _) in enumerate(plan, 1)], "place int, step string")


@add("agg43_cleaned", f"""WITH {GAPPY} SELECT p_partkey, coalesce(p_size, (SELECT median(p_size) FROM gappy)::INTEGER) AS p_size,
  coalesce(p_brand, (SELECT p_brand FROM gappy WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1)) AS p_brand FROM gappy""")
def _(t):
    return core.cleaned(gappy(t), core.audit(gappy(t)))


# --- streams --------------------------------------------------------------------------------------------------------


def _stream(t, df, name: str):
    """(a file stream of the rows, its folder)."""
    root = folder(t, name)
    df.write.parquet(f"{root}/in")
    return t.spark.readStream.schema(df.schema).parquet(f"{root}/in"), root


@add("stm1_event_log", "SELECT event_id, event_type FROM events")
def _(t):
    """Events appended to a log as they come."""
    log, root = _stream(t, t.events.select("event_id", "event_type"), "log")
    finished(log.writeStream.format("parquet").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out"))
    return t.spark.read.parquet(f"{root}/out")


@add("stm2_poll_view", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 13")
def _(t):
    """The last thirteen entries of every log, kept current over several micro-batches."""
    root, rows = folder(t, "view"), t.events.select("user_id", "event_id")
    rows.repartition(3).write.parquet(f"{root}/in")
    log = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    finished(q := streams.live_view(log, f"{root}/out", ["user_id"], [F.desc("event_id")], 13, f"{root}/c").trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{root}/out/v{q.lastProgress['batchId']}")


@add("stm2_live_changes", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 13")
def _(t):
    """The same view from keyed state: each micro-batch writes the keys it touched and nothing else."""
    root, rows = folder(t, "changes"), t.events.select("user_id", "event_id")
    rows.repartition(3).write.parquet(f"{root}/in")
    log = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    with keyed.state_store(t.spark):
        finished(keyed.view_changes(log, f"{root}/out", ["user_id"], "event_id", 13, f"{root}/c").trigger(availableNow=True).start())
    return keyed.view(t.spark, f"{root}/out", ["user_id"]).select("user_id", "event_id")


@add("stm6_cooldown_stream", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
  f AS (SELECT user_id, t, n, NULL::VARCHAR AS reason, t AS last, 1 AS k FROM e WHERE n = 1 UNION ALL
  SELECT user_id, t, n, w, CASE WHEN w IS NULL THEN t ELSE last END, k + (w IS NULL)::INTEGER FROM (SELECT e.*, f.last, f.k,
    CASE WHEN trunc(3600 - (e.t - f.last) / 1000000.0::DOUBLE) > 0 THEN 'cooldown' WHEN f.k >= 5 THEN 'cap' END AS w
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)) SELECT user_id, t AS at, reason FROM f""")
def _(t):
    """The cool-down as a stream of three time ranges, with its state by user between the micro-batches."""
    root = folder(t, "cooldown")
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    for i, day in enumerate(("2024-01-01", "2024-01-11", "2024-01-21")):
        past = F.col("ts") >= F.lit(day).cast("timestamp") if i else F.lit(True)
        before = F.col("ts") < F.date_add(F.lit(day).cast("date"), 10).cast("timestamp") if i < 2 else F.lit(True)
        rows.filter(past & before).coalesce(1).write.parquet(f"{root}/in/{i}")
    log = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    with keyed.state_store(t.spark):
        finished(keyed.cooled_down(log, "user_id", "ts", 3600, 5).writeStream.format("parquet").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out"))
    return t.spark.read.parquet(f"{root}/out").select(F.col("who").alias("user_id"), "at", "reason")


@add("stm9_live_progress", "SELECT true AS never_falls, true AS complete, 100.0::DOUBLE AS percent FROM events LIMIT 1")
def _(t):
    """What is reported while the events are read in micro-batches: it ends at 100 % and never falls."""
    root, rows = folder(t, "progress"), t.events.select("event_id")
    rows.repartition(4).write.parquet(f"{root}/in")
    log = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    writer = keyed.observed(log, "done").writeStream.format("parquet").option("checkpointLocation", f"{root}/c").option("path", f"{root}/out")
    return keyed.stages_done(keyed.run_with_progress(t.spark, writer, keyed.Progress("done", rows.count())), ["batch"])


@add("stm3_schedule", """SELECT tick FROM (SELECT unnest(generate_series(TIMESTAMP '1998-06-30 00:00:00', TIMESTAMP '1998-07-08 00:00:00', INTERVAL 60 MINUTE)) AS tick)
  WHERE isodow(tick) <= 5 AND month(tick) * 100 + day(tick) NOT IN (101, 619, 704, 1225) AND hour(tick) * 60 + minute(tick) BETWEEN 570 AND 959""")
def _(t):
    return streams.ticks(t.spark, "1998-06-30 00:00:00", "1998-07-08 00:00:00", 60)


@add("stm7_replay", "SELECT event_id, ts::DATE AS day, dense_rank() OVER (ORDER BY ts::DATE) - 1 AS step FROM events")
def _(t):
    rows = t.events.select("event_id", F.to_date("ts").alias("day"))
    return streams.replay(rows, rows).select("event_id", "day", "step")


@add("stm8_completion_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) + (value * 1000000)::BIGINT, event_id) AS place FROM events")
def _(t):
    done = F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1_000_000).cast("long")
    return streams.completion_order(t.events, "user_id", done, "event_id").select("event_id", "place")


@add("stm9_progress", "SELECT event_id, row_number() OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total, round(100.0::DOUBLE * row_number() OVER w / count(*) OVER (PARTITION BY user_id), 1) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(t):
    return streams.progress(t.events.select("event_id", "user_id"), "user_id", ["event_id"]).select("event_id", "done", "total", "percent")


@add("stm10_span_durations", """WITH n AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
  SELECT s.user_id * 100000 + s.n AS span_id, epoch_us(e.ts) - epoch_us(s.ts) AS us FROM n s JOIN n e ON s.user_id = e.user_id AND s.n = e.n AND s.event_type = 'view' AND e.event_type = 'click'
  WHERE e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 12 HOUR""")
def _(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 100000 + F.row_number().over(w)).alias("span_id"))
    pairs = streams.paired(rows.filter("event_type = 'view'"), rows.filter("event_type = 'click'"), longest="12 hours")
    return pairs.select("span_id", (F.unix_micros("ended") - F.unix_micros("started")).alias("us"))


@add("stm14_late_rows", "SELECT * FROM (VALUES (TIMESTAMP '2024-01-01 10:00:00', 2), (TIMESTAMP '2024-01-01 12:00:00', 2)) v(start, n)")
def _(t):
    """Rows older than the watermark are dropped: the fourth file's row of ten o'clock comes when eleven has passed."""
    root = folder(t, "late")
    schema = "ts timestamp, value double"
    for minutes in ((600, 610), (725,), (730,), (605,), (900,)):
        rows = t.spark.createDataFrame([(m,) for m in minutes], "m long").select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("ts"), F.lit(1.0).alias("value"))
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    closed = streams.tumbling(stream, "ts", "1 hour", [], late="1 hour").select("start", "n")
    finished(closed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out"))
    return t.spark.read.parquet(f"{root}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


# --- functions of a user ----------------------------------------------------------------------------------------------


@add("udf2_tool_schema", """SELECT '{"type": "object", "properties": {"name": {"type": "string"}, "least": {"type": "number"}}, "required": ["name"], "additionalProperties": false}' AS "schema" """)
def _(t):
    import json

    r = Registry()

    @r.tool
    def balance(spark, name: str, least: float = 0.0):
        return spark.range(0)

    return t.spark.createDataFrame([(json.dumps(r.schema("balance")),)], "`schema` string")


@add("udf4_row_apply", "SELECT item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INTEGER AS n_words, length(text)::INTEGER AS n_chars FROM benchmark")
def _(t):
    """A function of a row that gives several columns, on Arrow batches."""

    @F.pandas_udf("n_words int, n_chars int")
    def measure(text: pd.Series) -> pd.DataFrame:
        filled = text.fillna("")
        return pd.DataFrame({"n_words": filled.map(lambda x: len(x.split())).astype("int32"), "n_chars": filled.str.len().astype("int32")})

    return t.benchmark.select("item_id", measure("text").alias("m")).select("item_id", "m.*")


@add("udf5_map_elements", "SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: length(w)), ',') AS lengths FROM benchmark")
def _(t):
    """A function of an element that gives a list."""

    @F.pandas_udf("array<int>")
    def lengths(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda x: [len(w) for w in x.split()])

    return t.benchmark.select("item_id", F.array_join(lengths("text").cast("array<string>"), ",").alias("lengths"))


@add("udf9_query_flow", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    """List, describe, write, check and run; the writer of queries is pluggable and here a rule."""
    t.nation.select("n_nationkey", "n_regionkey").createOrReplaceTempView("asked_nation")

    def rule(question: str, tables_: str) -> str:
        table = next(line.split("(")[0] for line in tables_.split("\n") if "nation" in question and line.startswith("asked_nation"))
        return f"SELECT n_regionkey, count(*) AS n FROM {table} GROUP BY n_regionkey"

    return sqlguard.ask(t.spark, "how many nations has a region?", rule)[1]


#: Questions over several tables, and the SQL that answers them.
QUESTIONS = {
    "How many customers per mktsegment?": "SELECT c_mktsegment AS k, count(*)::DOUBLE AS v FROM customer GROUP BY 1",
    "What is the average totalprice of orders by orderpriority?": "SELECT o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 1",
    "What is the highest acctbal of customers per nation name?": "SELECT n_name, max(c_acctbal) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "How many parts with size over 20 and brand is Brand#3?": "SELECT NULL, count(*) FROM part WHERE p_size > 20 AND p_brand = 'Brand#3'",
    "What is the total quantity of lineitems by returnflag where discount at least 0.05?": "SELECT l_returnflag, sum(l_quantity) FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1",
}


@add("udf9_several_questions", " UNION ALL ".join("SELECT '{}' AS question, k::VARCHAR AS k, round(v, 4) AS v FROM ({}) q(k, v)".format(q, s) for q, s in QUESTIONS.items()))
def _(t):
    """Questions answered from the listed schema by a rule; every query passes the guard before it runs."""
    for name in ("customer", "orders", "part", "lineitem", "nation"):
        getattr(t, name).createOrReplaceTempView(f"open_{name}")
    out = None
    for question in QUESTIONS:
        rows = sqlguard.ask(t.spark, question, lambda q, d: asking.write_query(q, "\n".join(x for x in d.split("\n") if x.startswith("open_"))), limit=None)[1]
        key = F.lit(None).cast("string") if len(rows.columns) == 1 else F.col(f"`{rows.columns[0]}`").cast("string")
        one = rows.select(F.lit(question).alias("question"), key.alias("k"), F.round(F.col(f"`{rows.columns[-1]}`").cast("double"), 4).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@add("udf10_model_score", r"""SELECT item_id, round(len(list_intersect(a, b)) / len(a), 6) AS score FROM (SELECT item_id, list_distinct(list_filter(string_split_regex(b.text, '\s+'), lambda w: w <> '')) AS a,
  list_distinct(list_filter(string_split_regex(d.text, '\s+'), lambda w: w <> '')) AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id) WHERE len(a) > 0""")
def _(t):
    """A model's score of each pair, here the share of the query's words that the text has."""

    def model(queries: list[str], texts: list[str]) -> list[float]:
        pairs = [(set(q.split()), set(x.split())) for q, x in zip(queries, texts, strict=True)]
        return [len(q & x) / len(q) if q else 0.0 for q, x in pairs]

    pairs = t.benchmark.select("item_id", F.col("text").alias("q")).join(t.documents.select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return pairs.select("item_id", F.round(R.model_scorer(model)(F.col("q"), F.col("text")), 6).alias("score"))
