"""Sources, projections, filters, joins, sinks and set operations over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import activity, aggregate, core, ledger, similarity, web
from millrace.plans.base import Catalogue
from millrace.plans.texts import HTML
from millrace.sources import sinks, tables

C = Catalogue()
add = C.add
ts = lambda s: F.lit(s).cast("timestamp_ntz")

#: Trades as a SQL view, the same mapping as ``sources.tables.trades``.
TRADES = """trades AS (SELECT o.o_custkey AS account, l.l_partkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
  l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed,
  l_extendedprice / l_quantity AS price, l_shipdate AS ts, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
PRICES = "prices AS (SELECT p_partkey AS symbol, p_retailprice AS price FROM part WHERE p_partkey % 10 <> 0)"


def trades(t):
    return tables.trades(t.spark, t.sf_dir)


def prices(t):
    """A market snapshot with gaps: every tenth symbol has no price."""
    return t.part.filter(F.col("p_partkey") % 10 != 0).select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))


# --- sources and projections ----------------------------------------------------------------------------------------


@add("src1_point_read", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')")
def _(t):
    return t.customer.filter(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000042"))).select("c_custkey", "c_name", "c_acctbal")


@add("src3_full_scan", "SELECT p_partkey, p_brand FROM part")
def _(t):
    return t.part.select("p_partkey", "p_brand")


@add("src5_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_nr FROM orders")
def _(t):
    return tables.with_row_index(t.orders.select("o_orderkey"), "o_orderkey")


@add("src17_vector_scan", "SELECT vec_id, label, len(embedding)::INTEGER AS dims FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", "label", F.size("embedding").alias("dims"))


@add("src19_head", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1")
def _(t):
    return t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").limit(1)


@add("prj1_columns", "SELECT event_id, event_type FROM events")
def _(t):
    return t.events.select("event_id", "event_type")


@add("prj2_records", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS record FROM nation""")
def _(t):
    return t.nation.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("record"))


@add("prj3_holdings_rows", f"WITH {TRADES} SELECT account, symbol, sum(signed) AS quantity FROM trades GROUP BY ALL HAVING sum(signed) <> 0")
def _(t):
    held = ledger.holdings(trades(t)).groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "quantity"))).alias("held"))
    return held.select("account", F.explode("held").alias("symbol", "quantity"))


@add("prj4_array_rows", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, role FROM conversations")
def _(t):
    nested = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return nested.select("conv_id", F.posexplode("turns").alias("pos", "x")).select("conv_id", "pos", "x.turn", "x.role")


@add("prj5_drop_field", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    doc = t.supplier.select(F.struct("s_suppkey", "s_name", "s_acctbal").alias("doc"))
    return doc.select(F.col("doc").dropFields("s_acctbal").alias("doc")).select("doc.*")


@add("prj6_money", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity * 1.002::DOUBLE AS buy_at,
  l_extendedprice / l_quantity * 0.998::DOUBLE AS sell_at FROM lineitem""")
def _(t):
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.buy_price(p).alias("buy_at"), N.sell_price(p).alias("sell_at"))


@add("prj8_conditional_text", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large ' || p_brand ELSE p_brand END AS label FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit("large "), "p_brand")).otherwise(F.col("p_brand")).alias("label"))


@add("prj9_chunk_ids", "SELECT doc_id || '_' || i AS id FROM (SELECT doc_id, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1))).select(F.concat_ws("_", "doc_id", F.col("pos") + 1).alias("id"))


@add("prj10_map_values", "SELECT r_regionkey, upper(r_name) AS name FROM region")
def _(t):
    m = t.region.agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("m"))
    return m.select(F.explode(F.transform_values("m", lambda k, v: F.upper(v))).alias("r_regionkey", "name"))


@add("prj11_bind_by_id", "SELECT c.c_custkey, c.c_name, c.c_mktsegment FROM customer c")
def _(t):
    return t.customer.select("c_custkey", "c_name").join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")


@add("prj13_drop_columns", "SELECT r_regionkey FROM region")
def _(t):
    return t.region.drop("r_name", "no_such_column")


@add("prj14_numeric_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    return t.customer.select(*[c for c, k in t.customer.dtypes if k in ("int", "bigint", "double")])


# --- filters --------------------------------------------------------------------------------------------------------


@add("flt1_equal_folded", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12'")
def _(t):
    return t.part.filter(F.lower("p_brand") == "brand#12").select("p_partkey")


@add("flt2_text_dates", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-03-31'")
def _(t):
    return t.orders.filter(F.date_format("o_orderdate", "yyyy-MM-dd").between("1995-01-01", "1995-03-31")).select("o_orderkey")


@add("flt3_epoch_range", "SELECT o_orderkey FROM orders WHERE epoch(o_orderdate)::BIGINT BETWEEN 800000000 AND 800000000 + 90 * 86400")
def _(t):
    e = F.unix_timestamp("o_orderdate")
    return t.orders.filter((e >= 800_000_000) & (e <= 800_000_000 + 90 * 86400)).select("o_orderkey")


@add("flt4_recent", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(t):
    last = t.events.agg(F.max("ts").alias("anchor"))
    return t.events.crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("anchor") - F.expr("INTERVAL 1 DAY")).select("event_id")


@add("flt5_optional_conjuncts", "SELECT event_id FROM events WHERE event_type = 'error' AND value >= 10")
def _(t):
    wanted = {"event_type": "error", "user_id": None}
    return core.where(t.events, **wanted).filter(F.col("value") >= 10).select("event_id")


@add("flt6_like", "SELECT n_name FROM nation WHERE n_name ILIKE '%an%'")
def _(t):
    return t.nation.filter(F.contains(F.lower("n_name"), F.lit("an"))).select("n_name")


@add("flt7_range_and_status", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'O'")
def _(t):
    return t.orders.filter(F.col("o_totalprice").between(1000, 50000) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@add("flt8_isin_either", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') OR p_size IN (1, 2)")
def _(t):
    return t.part.filter(F.col("p_brand").isin("Brand#11", "Brand#12") | F.col("p_size").isin(1, 2)).select("p_partkey")


@add("flt9_array_features", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass')")
def _(t):
    features = F.array_join(F.transform(F.split("p_type", " "), F.lower), " ")
    return t.part.filter(F.exists(F.array(F.lit("steel"), F.lit("brass")), lambda r: F.contains(features, r))).select("p_partkey")


@add("flt10_metric_or_class", "SELECT s_suppkey FROM supplier WHERE s_acctbal / 2 >= 3000 OR s_nationkey = 3")
def _(t):
    return t.supplier.filter((F.col("s_acctbal") / 2 >= 3000) | (F.col("s_nationkey") == 3)).select("s_suppkey")


@add("flt11_present", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(t):
    return t.documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id")


@add("flt12_multi_key", "SELECT o_orderkey FROM orders WHERE o_orderkey = 7 AND upper(o_orderstatus) = 'O' OR lower(o_orderpriority) = '1-urgent' AND lower(o_orderstatus) = 'f'")
def _(t):
    one = (F.col("o_orderkey") == 7) & (F.upper("o_orderstatus") == "O")
    return t.orders.filter(one | (F.lower("o_orderpriority") == "1-urgent") & (F.lower("o_orderstatus") == "f")).select("o_orderkey")


@add("flt14_length_gate", "SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 100 AS meaningful FROM documents")
def _(t):
    return t.documents.select("doc_id", X.meaningful(F.col("text")).alias("meaningful"))


PII_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for k, p in sorted(X.SENSITIVE.items()))


@add("flt15_pii_types", f"SELECT doc_id, array_to_string(list_filter([{PII_SQL}], lambda k: k IS NOT NULL), ',') AS kinds FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.sensitive_kinds(F.col("text")), ",").alias("kinds"))


KW_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in X.HARMFUL)


@add("flt16_keywords", f"SELECT doc_id, array_to_string(list_filter([{KW_SQL}], lambda k: k IS NOT NULL), ',') AS matched FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.contained(F.col("text"), X.HARMFUL), ",").alias("matched"))


@add("flt18_optional_equal", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return core.where(t.customer, c_mktsegment="BUILDING", c_nationkey=None).select("c_custkey")


@add("flt20_assertions", """SELECT 'priced' AS check, count(*) FILTER (WHERE NOT p_retailprice > 0) = 0 AS passed, count(*) FILTER (WHERE NOT p_retailprice > 0) AS failing FROM part
  UNION ALL SELECT 'small', count(*) FILTER (WHERE NOT p_size < 40) = 0, count(*) FILTER (WHERE NOT p_size < 40) FROM part
  UNION ALL SELECT 'brand', count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#1')) = 0, count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#1')) FROM part""")
def _(t):
    rules = [("priced", "greater", "p_retailprice", 0), ("small", "less", "p_size", 40), ("brand", "regex", "p_brand", "^Brand#1")]
    return reduce(lambda a, b: a.unionByName(b), [core.check(t.part, n, k, F.col(c), v) for n, k, c, v in rules])


@add("flt21_reject_reason", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'side' WHEN NOT l_quantity - 5 > 0 THEN 'quantity'
  WHEN NOT l_extendedprice > 0 THEN 'price' END AS reason FROM lineitem""")
def _(t):
    side = F.when(F.col("l_returnflag") == "A", "Buy").when(F.col("l_returnflag") == "R", "SELL").otherwise("hold")
    why = ledger.reject_reason(side, F.col("l_quantity") - 5, F.col("l_extendedprice"), F.col("l_partkey").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", why.alias("reason"))


@add("flt22_trading_days", """SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE isodow(o_orderdate) <= 5
  AND month(o_orderdate) * 100 + day(o_orderdate) NOT IN (101, 619, 704, 1225)""")
def _(t):
    from millrace.functions.dates import is_trading_day

    return t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().filter(is_trading_day(F.col("day")))


@add("flt23_min_severity", """SELECT event_id, r FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 999 END AS r FROM events) WHERE r <= 1""")
def _(t):
    rank = F.create_map(*[F.lit(x) for kv in (("error", 0), ("purchase", 1), ("signup", 2)) for x in kv])
    return t.events.select("event_id", F.coalesce(rank[F.col("event_type")], F.lit(999)).alias("r")).filter("r <= 1").orderBy("r")


# --- joins ----------------------------------------------------------------------------------------------------------


@add("jon1_price_lookup", f"WITH {TRADES}, {PRICES}, h AS (SELECT account, symbol, sum(signed) AS quantity FROM trades GROUP BY ALL HAVING sum(signed) <> 0) "
     "SELECT account, h.symbol, quantity, coalesce(price, 0) AS price, round(quantity * coalesce(price, 0), 2) + 0.0::DOUBLE AS value FROM h LEFT JOIN prices p ON h.symbol = p.symbol")
def _(t):
    return ledger.valued(ledger.holdings(trades(t)), prices(t)).withColumn("value", F.round("value", 2))


@add("jon3_semi_expand", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def _(t):
    ids = t.events.filter("event_type = 'error' AND value > 50").select("user_id").distinct()
    return t.events.join(ids, "user_id", "left_semi").select("event_id", "user_id")


@add("jon4_customer_latest_order", """SELECT c_custkey, count(o_orderkey) AS n_orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t.customer.select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "latest")


@add("jon6_outer_score_merge", """WITH a AS (SELECT p_partkey AS id, p_retailprice AS s FROM part WHERE p_size < 30), b AS (SELECT p_partkey AS id, p_size::DOUBLE AS s FROM part WHERE p_size > 20)
  SELECT coalesce(a.id, b.id) AS id, round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b ON a.id = b.id""")
def _(t):
    a = t.part.filter("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"))
    b = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("b"))
    return a.join(b, "id", "full").select("id", F.round(N.fuse(F.col("a"), F.col("b")), 6).alias("score"))


@add("jon7_zip", "SELECT n_nationkey, unnest([n_name, 'code']) AS k, unnest([n_regionkey::VARCHAR, n_nationkey::VARCHAR]) AS v FROM nation")
def _(t):
    names, values = F.array("n_name", F.lit("code")), F.array(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    return t.nation.select("n_nationkey", F.inline(F.arrays_zip(names.alias("k"), values.alias("v"))))


@add("jon9_latest_per_key", """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return sinks.latest_by(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@add("jon10_asof_price", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_returnflag <> 'A'),
  r AS (SELECT l_partkey, l_shipdate, max(l_extendedprice) AS px FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, px FROM l ASOF LEFT JOIN r ON l.l_partkey = r.l_partkey AND l.l_shipdate >= r.l_shipdate""")
def _(t):
    left = t.lineitem.filter("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    right = t.lineitem.filter("l_returnflag = 'A'").groupBy("l_partkey", "l_shipdate").agg(F.max("l_extendedprice").alias("px"))
    return core.as_of(left, right, "l_partkey", "l_shipdate", "l_shipdate", "px")


@add("jon12_anti_unseen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@add("jon13_span_pairs", """SELECT s.user_id * 100000 + s.n AS span_id, s.ts AS started, e.ts AS ended, ((abs(epoch_us(e.ts) - epoch_us(s.ts)) + 5) // 10 * sign(epoch_us(e.ts) - epoch_us(s.ts))) / 100.0::DOUBLE AS duration_ms FROM
  (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') s LEFT JOIN
  (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') e ON s.user_id = e.user_id AND s.n = e.n""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = lambda kind: t.events.filter(F.col("event_type") == kind).select((F.col("user_id") * 100000 + F.row_number().over(w)).alias("span_id"), "ts")
    return activity.span_pairs(side("view"), side("click"))


SPANS = """spans AS (SELECT event_id AS span_id, nullif(event_id // 3, event_id) AS parent_id, user_id AS trace_id, ts AS started,
  ts + to_microseconds((value * 1000)::BIGINT) AS ended, value AS duration, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events WHERE event_id <> 5)"""


def spans(t):
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("long")).cast("timestamp_ntz")
    parent = F.expr("nullif(event_id div 3, event_id)")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return t.events.filter("event_id <> 5").select(F.col("event_id").alias("span_id"), parent.alias("parent_id"), F.col("user_id").alias("trace_id"), F.col("ts").alias("started"), end.alias("ended"), F.col("value").alias("duration"), status.alias("status"))


@add("jon18_parent_child", f"""WITH RECURSIVE {SPANS}, s AS (SELECT span_id, CASE WHEN parent_id IN (SELECT span_id FROM spans) THEN parent_id END AS parent_id FROM spans),
  tree AS (SELECT span_id, parent_id, span_id AS root_id, 0 AS level FROM s WHERE parent_id IS NULL
  UNION ALL SELECT s.span_id, s.parent_id, tree.root_id, level + 1 FROM s JOIN tree ON s.parent_id = tree.span_id) SELECT * FROM tree""")
def _(t):
    return activity.span_tree(spans(t))


@add("agg45_trace_rollup", f"""WITH {SPANS} SELECT trace_id, min(started) AS started, max(ended) AS ended, arg_max(duration, (ended, span_id)) AS duration,
  CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status FROM spans GROUP BY trace_id""")
def _(t):
    return activity.trace_rollup(spans(t)).orderBy(F.desc("started"))


@add("jon19_calendar_expand", """WITH d AS (SELECT o_orderkey, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 6, INTERVAL 1 DAY))::DATE AS day FROM orders)
  SELECT o_orderkey, day FROM d WHERE month(day) * 100 + day(day) IN (101, 619, 704, 1225)""")
def _(t):
    from millrace.functions.dates import MARKET_HOLIDAYS

    start = F.to_date("o_orderdate")
    days = t.orders.select("o_orderkey", F.explode(F.sequence(start, F.date_add(start, 6))).alias("day"))
    calendar = t.spark.createDataFrame([(m * 100 + d,) for m, d in MARKET_HOLIDAYS], "md int")
    return days.join(core.small(calendar), F.month("day") * 100 + F.dayofmonth("day") == F.col("md"), "left_semi")


for how, key in (("inner", "inner"), ("left", "left"), ("right", "right"), ("full", "full")):

    @add(f"jon15_{key}", f"SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) {how} JOIN (SELECT * FROM region WHERE r_regionkey > 0) ON n_regionkey = r_regionkey")
    def _(t, how=how):
        return t.nation.filter("n_regionkey < 3").join(t.region.filter("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey"), how).select("n_name", "r_name")


@add("jon16_range_join", """SELECT e.event_id, count(p_partkey) AS parts, min(p_partkey) AS first_part FROM events e
  LEFT JOIN (SELECT p_partkey, p_size AS lo, p_size + 2 AS hi FROM part) p ON e.value BETWEEN lo AND hi GROUP BY 1""")
def _(t):
    """Parts whose size range holds an event's value, as a count: equal ranges are added up before the join."""
    s = t.part.groupBy(F.col("p_size").alias("lo")).agg(F.count("p_partkey").alias("n"), F.min("p_partkey").alias("first")).withColumn("hi", F.col("lo") + 2)
    hits = core.range_join(t.events.select("event_id", "value"), s, "value", "lo", "hi", 4).groupBy("event_id").agg(F.sum("n").alias("parts"), F.min("first").alias("first_part"))
    return t.events.select("event_id").join(hits, "event_id", "left").fillna(0, ["parts"])


@add("jon16_open_lines", """WITH s AS (SELECT epoch(o_orderdate)::BIGINT // 86400 AS lo, epoch(l_shipdate)::BIGINT // 86400 AS hi FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  d AS (SELECT DISTINCT epoch(o_orderdate)::BIGINT // 86400 AS day FROM orders), e AS (SELECT lo AS day, 1 AS n FROM s WHERE hi >= lo UNION ALL SELECT hi + 1, -1 FROM s WHERE hi >= lo UNION ALL SELECT day, 0 FROM d),
  r AS (SELECT day, sum(n) OVER (ORDER BY day RANGE UNBOUNDED PRECEDING) AS n FROM e) SELECT d.day, any_value(r.n)::BIGINT AS open_lines FROM d JOIN r USING (day) GROUP BY d.day""")
def _(t):
    """Line items that are ordered and not yet shipped past each order day: spans of years, counted by node of a binary tree."""
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000)
    spans = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(day("o_orderdate").alias("lo"), day("l_shipdate").alias("hi"))
    return core.interval_counts(t.orders.select(day("o_orderdate").alias("day")).distinct(), spans, "day", "lo", "hi", "open_lines")


@add("jon17_star_join", """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_norm = lambda c: rf"array_to_string(list_sort(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> '')), ' ')"


@add("jon11_fuzzy_names", f"""WITH q AS (SELECT DISTINCT string_split(n_name, ' ')[-1] || ' ' || lower(n_name) AS q FROM nation), n AS (SELECT DISTINCT n_name FROM nation),
  p AS (SELECT q, n_name, {_norm('q')} AS a, {_norm('n_name')} AS b FROM q, n), s AS (SELECT q, n_name, 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) AS score FROM p)
  SELECT q, n_name, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, n_name) AS rank FROM s WHERE score >= 50 QUALIFY rank <= 3""")
def _(t):
    q = t.nation.select(F.concat(F.reverse(F.split("n_name", " "))[0], F.lit(" "), F.lower("n_name")).alias("q"))
    return similarity.fuzzy_match(q, t.nation, "q", "n_name", 50, 3)


# An order's spelling of its part: every third one lacks a letter, every third has two words swapped and one doubled letter.
_SPELT = """CASE l_partkey % 3 WHEN 0 THEN substring(p_name, 1, CAST(l_partkey % length(p_name) AS INTEGER)) || substring(p_name, CAST(l_partkey % length(p_name) AS INTEGER) + 2)
  WHEN 1 THEN upper(split_part(p_name, ' ', 2)) || ' ' || split_part(p_name, ' ', 1) || substring(p_name, 1, 1) ELSE p_name || ' ' || p_name END"""
_PARTS = f"""o AS (SELECT DISTINCT {_SPELT} AS asked FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT DISTINCT p_name FROM part),
  p AS (SELECT asked, p_name, {_norm('asked')} AS a, {_norm('p_name')} AS b FROM o, n), s AS (SELECT asked, p_name, 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) AS score FROM p),
  m AS (SELECT asked, p_name, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, p_name) AS rank FROM s WHERE score >= 80 QUALIFY rank <= 3)"""


def asked_parts(t):
    spelt = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.expr(_SPELT).alias("asked"))
    return similarity.fuzzy_match(spelt, t.part, "asked", "p_name", 80, 3)


@add("jon11_fuzzy_parts", f"WITH {_PARTS} SELECT * FROM m")
def _(t):
    return asked_parts(t)


@add("jon11_auto_correct", f"""WITH {_PARTS} SELECT asked, CASE WHEN count(*) = 1 OR max(score) >= 90 THEN arg_min(p_name, rank) END AS corrected,
  string_agg(p_name, ', ' ORDER BY rank) AS suggestions FROM m GROUP BY asked""")
def _(t):
    return similarity.auto_correct(asked_parts(t), "asked", "p_name")


@add("jon10_asof_status", """WITH r AS (SELECT o_orderstatus, o_orderdate, max(o_totalprice) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
  SELECT o.o_orderkey, urgent FROM (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') o ASOF LEFT JOIN r ON o.o_orderstatus = r.o_orderstatus AND o.o_orderdate >= r.o_orderdate""")
def _(t):
    """Three keys hold all rows: each is scanned over many tasks."""
    left = t.orders.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_orderstatus", "o_orderdate")
    right = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy("o_orderstatus", "o_orderdate").agg(F.max("o_totalprice").alias("urgent"))
    return core.as_of(left, right, "o_orderstatus", "o_orderdate", "o_orderdate", "urgent", hot_rows=0).select("o_orderkey", "urgent")


# --- write paths ----------------------------------------------------------------------------------------------------


@add("snk1_upsert_latest", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return sinks.latest_by(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@add("snk2_replace", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def _(t):
    base = t.nation.select("n_nationkey", "n_name")
    return sinks.upsert(base, base.filter("n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), "n_nationkey")


@add("snk3_insert_ignore", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name FROM customer")
def _(t):
    """Every customer is inserted; those already there stay as they are."""
    base = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return sinks.insert_ignore(base, t.customer.select("c_custkey", F.lit("new").alias("c_name")), "c_custkey")


@add("snk4_reactivate", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'active' ELSE 'resolved' END AS status FROM supplier")
def _(t):
    """Alerts on all suppliers: those without one get it, those that were resolved become active again."""
    base = t.supplier.filter("s_suppkey % 3 <> 0").select("s_suppkey", "s_name", F.lit("resolved").alias("status"))
    rows = t.supplier.filter("s_suppkey % 2 = 0 OR s_suppkey % 3 = 0").select("s_suppkey", "s_name", F.lit("active").alias("status"))
    return sinks.upsert_columns(base, rows, "s_suppkey", {"status": F.lit("active")})


@add("snk5_append", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id + 1000000, 'replay' FROM events WHERE event_type = 'error'")
def _(t):
    return t.events.select("event_id", "event_type").unionByName(t.events.filter("event_type = 'error'").select((F.col("event_id") + 1000000).alias("event_id"), F.lit("replay").alias("event_type")))


@add("snk6_partial_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def _(t):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    changes = base.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderstatus"))
    return sinks.patch(base, changes, "o_orderkey")


@add("snk7_conditional_counter", """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS run_count, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id""")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("run_count"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@add("snk8_purge", "SELECT event_id FROM events WHERE NOT ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(t):
    last = t.events.agg(F.max("ts").alias("anchor"))
    return sinks.purge(t.events.crossJoin(F.broadcast(last)), F.col("ts") < F.col("anchor") - F.expr("INTERVAL 7 DAY")).select("event_id")


@add("snk9_purge_thread", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 3")
def _(t):
    return sinks.purge(t.conversations, F.col("conv_id") == 3).select("conv_id", "turn")


# --- sets -----------------------------------------------------------------------------------------------------------

A, B = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders"
_a = lambda t: t.customer.select(F.col("c_custkey").alias("k"))
_b = lambda t: t.orders.select(F.col("o_custkey").alias("k"))
for name, sql, op in (
    ("set1_union", f"{A} UNION {B}", lambda a, b: a.union(b).distinct()),
    ("set2_union_all", f"{A} UNION ALL {B}", lambda a, b: a.unionByName(b)),
    ("set5_distinct", f"SELECT DISTINCT k FROM ({B})", lambda a, b: b.distinct()),
    ("set8_intersect", f"{A} INTERSECT {B}", lambda a, b: a.intersect(b)),
    ("set8_intersect_all", f"{A} INTERSECT ALL {B}", lambda a, b: a.intersectAll(b)),
    ("set8_except", f"{A} EXCEPT {B}", lambda a, b: a.subtract(b)),
    ("set8_except_all", f"{B} EXCEPT ALL {A}", lambda a, b: b.exceptAll(a)),
):

    @add(name, sql)
    def _(t, op=op):
        return op(_a(t), _b(t))


@add("set3_union_first", f"SELECT k, min(side) AS side FROM (SELECT k, 1 AS side FROM ({A}) UNION ALL SELECT k, 2 FROM ({B})) GROUP BY k")
def _(t):
    both = _a(t).withColumn("side", F.lit(1)).unionByName(_b(t).withColumn("side", F.lit(2)))
    return both.groupBy("k").agg(F.min("side").alias("side"))


@add("set4_token_jaccard", r"""WITH s AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS w FROM benchmark)
  SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS j
  FROM s a JOIN s b ON a.item_id + 1 = b.item_id""")
def _(t):
    s = t.benchmark.select("item_id", X.token_set(F.col("text")).alias("w"))
    b = s.select(F.col("item_id").alias("b"), F.col("w").alias("v"))
    return s.join(b, F.col("item_id") + 1 == F.col("b")).select(F.col("item_id").alias("a"), "b", F.round(N.jaccard(F.col("w"), F.col("v")), 6).alias("j"))


_TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '')))"


@add("set4_similar_documents", f"""WITH s AS (SELECT doc_id, {_TOKENS} AS w FROM documents), c AS (SELECT w, min(doc_id) AS id, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
  e AS (SELECT id, n, unnest(w) AS token FROM c), o AS (SELECT x.id AS a, y.id AS b, any_value(x.n + y.n) AS n, count(*) AS common
  FROM e x JOIN e y ON x.token = y.token AND x.id < y.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) GROUP BY ALL)
  SELECT a, b, round(common / (n - common), 6) AS jaccard FROM o WHERE common >= 0.8 * (n - common) - 1e-9""")
def _(t):
    """Pairs of token sets with a similarity of 0.8 or more; equal sets stand under their smallest document."""
    sets = t.documents.select(F.col("doc_id").alias("id"), X.token_set(F.col("text")).alias("tokens"))
    return similarity.class_join(sets, 0.8).withColumn("jaccard", F.round("jaccard", 6))


@add("set6_ordered_unique", "SELECT user_id, array_to_string(list(event_type ORDER BY f, event_type), ',') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def _(t):
    return aggregate.aggregate(t.events, ["user_id"], ["event_id", "event_type"], aggregate.ordered_unique())


@add("set7_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


# --- pages ----------------------------------------------------------------------------------------------------------

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_sql_any = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
TIER = f"""CASE WHEN {_sql_any(HOST, web.SOCIAL)} THEN 'EXCLUDED' WHEN {_sql_any(HOST, web.PRIMARY)} OR {_sql_any(PATH, web.PAPER_PATHS)} THEN 'PRIMARY'
  WHEN {_sql_any(HOST, web.NEWS)} THEN 'SECONDARY' WHEN {_sql_any(HOST, web.OPINION)} THEN 'OPINION' ELSE 'VENDOR' END"""


@add("str9_domain", f"SELECT page_id, regexp_replace({HOST}, '^www[.]', '') AS site FROM pages")
def _(t):
    return t.pages.select("page_id", X.domain(F.col("url")).alias("site"))


@add("str10_source_tier", f"""SELECT page_id, {TIER} AS tier, CASE WHEN {_sql_any(HOST, web.GOVERNMENT)} THEN 'government' WHEN {_sql_any(HOST, web.ACADEMIC)} THEN 'academic'
  WHEN {_sql_any(HOST, web.SOCIAL)} THEN 'social' WHEN {_sql_any(HOST, web.NEWS)} THEN 'news' WHEN {_sql_any(HOST, web.BLOGS)} THEN 'blog' ELSE 'vendor' END AS publisher FROM pages""")
def _(t):
    return t.pages.select("page_id", web.source_tier(F.col("url")).alias("tier"), web.publisher(F.col("url")).alias("publisher"))


@add("flt19_excluded_domains", f"SELECT page_id FROM pages WHERE {TIER} <> 'EXCLUDED'")
def _(t):
    return t.pages.filter(web.source_tier(F.col("url")) != "EXCLUDED").select("page_id")


LANG = """nullif(regexp_extract(html, '(?is)<html\\b[^>]*?\\blang\\s*=\\s*["'']([^"'']*)["'']', 1), '')"""


@add("str18_html_lang", f"SELECT page_id, {LANG} AS lang FROM pages")
def _(t):
    return t.pages.select("page_id", X.html_lang(F.col("html")).alias("lang"))


@add("str20_links", """SELECT page_id, len(list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda u: regexp_matches(u, '^https?://'))) AS n FROM pages""")
def _(t):
    return t.pages.select("page_id", F.size(X.absolute_links(F.col("html"))).cast("long").alias("n"))


@add("prj7_page_status", f"""WITH p AS (SELECT page_id, {LANG} AS tag, regexp_extract(url, '/(en|fr|de|es)(/|$)', 1) AS seen FROM pages)
  SELECT page_id, CASE WHEN tag IS NULL OR lower(tag) <> seen THEN 'Critical' ELSE 'Keep' END AS status,
  CASE WHEN tag IS NULL THEN 'HTML lang attribute is missing.' WHEN lower(tag) <> seen THEN 'The detected text language does not match the HTML tag.' ELSE 'Perfect' END AS advice FROM p""")
def _(t):
    seen = F.regexp_extract("url", "/(en|fr|de|es)(/|$)", 1)
    status, advice = web.page_status(X.html_lang(F.col("html")), seen)
    return t.pages.select("page_id", status.alias("status"), advice.alias("advice"))


@add("src14_page_text", f"""SELECT page_id, {LANG} AS lang_tag, {HTML} AS body,
  len(list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda u: regexp_matches(u, '^https?://'))) AS n_links FROM pages""")
def _(t):
    return web.pages_text(t.pages).select("page_id", "lang_tag", "body", F.size("links").alias("n_links"))
