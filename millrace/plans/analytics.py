"""Aggregations, windows, sorting, ledger, profiling and activity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.operators import activity, aggregate, core, ledger, scan, sketches
from millrace.plans.base import Catalogue
from millrace.plans.relational import PRICES, TRADES, prices, trades
from millrace.session import materialise
from millrace.streaming import streams

C = Catalogue()
add = C.add

PROFIT = f"""{TRADES}, {PRICES}, h AS (SELECT account, symbol, sum(signed) AS q FROM trades GROUP BY ALL),
  f AS (SELECT account, sum(signed * price) AS spent, count(*) AS n_trades FROM trades GROUP BY account),
  w AS (SELECT account, sum(q * coalesce(price, 0)) AS stock FROM h LEFT JOIN prices p ON h.symbol = p.symbol GROUP BY account),
  p AS (SELECT f.account, spent, n_trades, 10000 - spent AS cash, 10000 - spent + stock AS value, stock - spent AS pnl FROM f JOIN w ON f.account = w.account)"""
two = lambda c, n=None: F.round(c, 2).alias(n or c)


@add("agg1_sum_by_category", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1995-12-31' GROUP BY 1 ORDER BY 1")
def _(t):
    some = t.orders.filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz")))
    return some.groupBy("o_orderpriority").agg(two(F.sum("o_totalprice"), "total")).orderBy("o_orderpriority")


@add("agg2_recent_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1")
def _(t):
    last = t.events.agg(F.max("ts").alias("anchor"))
    recent = t.events.crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("anchor") - F.expr("INTERVAL 6 HOUR"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@add("agg3_active_count", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def _(t):
    return t.events.agg(F.count_if(F.col("event_type") == "error").alias("n"))


@add("agg4_method_report", "SELECT event_type, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS sd, round(avg(user_id), 3) AS mean_user FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_samp("value"), 3).alias("sd"), F.round(F.avg("user_id"), 3).alias("mean_user"))


@add("agg5_means_by_category", "SELECT p_brand, round(avg(p_size), 4) AS size, round(avg(p_retailprice), 4) AS price, round(avg(p_partkey), 4) AS key FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (("p_size", "size"), ("p_retailprice", "price"), ("p_partkey", "key"))])


@add("agg6_global_means", "SELECT round(avg(c_acctbal), 4) AS balance, round(avg(c_nationkey), 4) AS nation FROM customer")
def _(t):
    return t.customer.agg(F.round(F.avg("c_acctbal"), 4).alias("balance"), F.round(F.avg("c_nationkey"), 4).alias("nation"))


@add("agg7_portfolio_value", f"WITH {PROFIT} SELECT account, round(value, 2) AS value FROM p")
def _(t):
    return ledger.profit(trades(t), prices(t)).select("account", two("value"))


@add("agg8_profit_loss", f"WITH {PROFIT} SELECT account, round(spent, 2) AS spent, round(cash, 2) AS cash, round(pnl, 2) AS pnl FROM p")
def _(t):
    return ledger.profit(trades(t), prices(t)).select("account", two("spent"), two("cash"), two("pnl"))


@add("agg9_roi_leaderboard", f"WITH {PROFIT} SELECT row_number() OVER (ORDER BY round(pnl / 100, 4) DESC, account) AS place, account, round(pnl / 100, 4) AS roi, n_trades, value <= 0 AS bankrupt FROM p")
def _(t):
    p = ledger.profit(trades(t), prices(t)).withColumn("roi", F.round("roi", 4)).withColumn("neg", -F.col("roi"))
    from millrace.sources.tables import with_row_index

    return with_row_index(p, "neg", "account").select((F.col("row_nr") + 1).alias("place"), "account", "roi", "n_trades", (F.col("value") <= 0).alias("bankrupt"))


@add("agg10_group_documents", """WITH r AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM events)
  SELECT user_id, month, string_agg(event_type, ' ' ORDER BY n) FILTER (WHERE n <= 20) AS body, count(*) AS item_count FROM r GROUP BY ALL""")
def _(t):
    dated = t.events.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return aggregate.aggregate(dated, ["user_id", "month"], ["at", "event_id", "event_type"], aggregate.first_n(20))


@add("agg11_batches", "SELECT user_id, (n - 1) // 15 AS batch, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY ALL")
def _(t):
    return core.batches(t.events, ["user_id"], ["event_id"], 15).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@add("agg12_group_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


RANKED = "r AS (SELECT label AS item, vec_id % 50 AS judge, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS pos FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id % 50, label ORDER BY vec_id) = 1)"


def ranked(t):
    w = Window.partitionBy("judge").orderBy("vec_id")
    one = Window.partitionBy("judge", "item").orderBy("vec_id")
    r = t.embeddings.select(F.col("label").alias("item"), (F.col("vec_id") % 50).alias("judge"), "vec_id")
    return r.select("item", "judge", F.row_number().over(w).alias("pos"), F.row_number().over(one).alias("o")).filter("o = 1")


for key, cols in (("agg13_rank_sum", "rank_sum, mean_rank"), ("agg14_mean_rank", "mean_seen"), ("agg15_borda", "points")):

    @add(key, f"""WITH {RANKED}, n AS (SELECT count(DISTINCT judge) AS j, count(DISTINCT item) AS m FROM r), s AS (SELECT item, sum(pos)::BIGINT AS rank_sum, round(sum(pos) / max(j), 6) AS mean_rank,
      round(avg(pos), 6) AS mean_seen, sum(m + 1 - pos)::BIGINT AS points FROM r, n GROUP BY item) SELECT item, {cols} FROM s""")
    def _(t, cols=cols):
        b = core.borda(ranked(t), "item", "pos", "judge").withColumns({"mean_rank": F.round("mean_rank", 6), "mean_seen": F.round("mean_seen", 6)})
        return b.select("item", *cols.split(", "))


@add("agg16_token_stats", "SELECT count(*) AS chunks, coalesce(sum(n), 0)::BIGINT AS total, min(n) AS smallest, max(n) AS largest, round(avg(n), 4) AS mean FROM (SELECT len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS n FROM benchmark)")
def _(t):
    from millrace.operators.chunks import chunk_stats

    return chunk_stats(t.benchmark, "text")


@add("agg17_distribution", "SELECT count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE quality = 1) AS good FROM labels")
def _(t):
    n = lambda c, v, a: F.count_if(F.col(c) == v).alias(a)
    return t.labels.agg(n("toxic", 1, "toxic"), n("toxic", 0, "clean"), n("quality", 1, "good"))


@add("agg18_extremes", "SELECT event_type, arg_max(event_id, (value, -event_id)) AS highest, arg_min(event_id, (value, event_id)) AS lowest FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("highest"), F.min_by("event_id", F.struct("value", "event_id")).alias("lowest"))


@add("agg19_price_range", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


GAPPY = "gappy AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS p_brand, 'x' AS fixed FROM part)"


def gappy(t):
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("p_brand"), F.lit("x").alias("fixed"))


def _per_column(expr: str, value: str) -> str:
    return f"WITH {GAPPY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} AS {value} FROM gappy" for c in ("p_partkey", "p_size", "p_brand", "fixed"))


@add("agg20_missing", _per_column("count(*) FILTER (WHERE {c} IS NULL)", "missing"))
def _(t):
    return core.missing(gappy(t))


@add("agg21_duplicates", "SELECT (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)")
def _(t):
    return core.duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@add("agg22_nunique", _per_column("count(DISTINCT {c})", "n_distinct"))
def _(t):
    return core.distinct(gappy(t))


@add("agg23_constant_columns", _per_column("count(DISTINCT {c}) = 1", "constant"))
def _(t):
    return core.distinct(gappy(t)).select("column", (F.col("n_distinct") == 1).alias("constant"))


@add("agg24_class_balance", 'SELECT toxic AS "class", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic')
def _(t):
    return core.class_balance(t.labels, "toxic").withColumn("share", F.round("share", 6))


@add("agg25_median_impute", f"WITH {GAPPY} SELECT p_partkey, coalesce(p_size, (SELECT median(p_size) FROM gappy)::INTEGER) AS p_size FROM gappy")
def _(t):
    return core.impute(gappy(t).select("p_partkey", "p_size"), ["p_size"])


@add("agg26_mode_impute", f"WITH {GAPPY} SELECT p_partkey, coalesce(p_brand, (SELECT p_brand FROM gappy WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1)) AS p_brand FROM gappy")
def _(t):
    return core.impute(gappy(t).select("p_partkey", "p_brand"), ["p_brand"])


@add("agg27_corr", "SELECT 'p_size' AS x, 'p_retailprice' AS y, round(corr(p_size, p_retailprice), 6) AS r FROM part UNION ALL SELECT 'p_size', 'p_size', 1 "
     "UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1 UNION ALL SELECT 'p_retailprice', 'p_size', round(corr(p_size, p_retailprice), 6) FROM part")
def _(t):
    return core.correlation(t.part, ["p_size", "p_retailprice"]).withColumn("r", F.round("r", 6))


@add("agg28_histogram", "WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM customer, e GROUP BY 1")
def _(t):
    return core.histogram(t.customer, "c_acctbal")


@add("agg28_quartiles", "SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer")
def _(t):
    q = F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t.customer.agg(q.alias("q")).select(*[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


@add("agg29_all_true_lowest", "SELECT user_id, bool_and(value < 95) AS calm, arg_min(event_type, (length(event_type), event_type)) AS lowest FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.every(F.col("value") < 95).alias("calm"), F.min_by("event_type", F.struct(F.length("event_type"), "event_type")).alias("lowest"))


@add("agg30_first_text", "SELECT conv_id, arg_min(trim(text), turn) FILTER (WHERE trim(text) <> '') AS first_text FROM conversations GROUP BY 1")
def _(t):
    body = F.nullif(F.trim("text"), F.lit(""))
    return t.conversations.groupBy("conv_id").agg(F.min_by(F.when(body.isNotNull(), body), F.when(body.isNotNull(), F.col("turn"))).alias("first_text"))


@add("agg31_concat", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


@add("agg32_total_cost", f"WITH {GAPPY} SELECT round(sum(p_size * 2.5), 2)::DOUBLE AS total FROM gappy")
def _(t):
    return gappy(t).agg(two(F.sum(F.col("p_size") * 2.5), "total"))


@add("agg33_budget_bands", "SELECT o_custkey, CASE WHEN sum(o_totalprice) / 10000 < 80 THEN 'ok' WHEN sum(o_totalprice) / 10000 < 100 THEN 'near' ELSE 'over' END AS status FROM orders GROUP BY 1")
def _(t):
    share = F.sum("o_totalprice") / 10000
    return t.orders.groupBy("o_custkey").agg(F.when(share < 80, "ok").when(share < 100, "near").otherwise("over").alias("status"))


@add("agg34_hit_rate", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type IN ('view', 'error')) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type IN ('view', 'error')), 4) END AS rate FROM events GROUP BY 1")
def _(t):
    hits, all_ = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("view", "error"))
    return t.events.groupBy("user_id").agg(F.when(all_ == 0, 0.0).otherwise(F.round(100.0 * hits / all_, 4)).alias("rate"))


@add("agg35_speed_up", "WITH a AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round(m, 4) AS mean, round((SELECT m FROM a WHERE event_type = 'view') / m, 4) AS speed_up FROM a")
def _(t):
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    ref = t.events.filter("event_type = 'view'").agg(F.avg("value").alias("ref"))  # one row
    return a.crossJoin(F.broadcast(ref)).select("event_type", F.round("m", 4).alias("mean"), F.round(F.col("ref") / F.col("m"), 4).alias("speed_up"))


@add("agg36_keyword_coverage", "SELECT doc_id, 100.0 * (contains(lower(text), 'the')::INT + contains(lower(text), 'la ')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'zzz')::INT) / 4 AS coverage FROM documents")
def _(t):
    from millrace.operators.retrieval import keyword_coverage

    words = F.array(*[F.lit(w) for w in ("the", "la ", "UND", "zzz")])
    return t.documents.select("doc_id", keyword_coverage(words, F.array("text")).alias("coverage"))


@add("agg37_count_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def _(t):
    return t.events.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@add("agg38_unique_texts", "SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.dropDuplicates(["source", "text"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


for key, sql, f in (
    ("rollup", "ROLLUP (l_returnflag, l_linestatus)", lambda d: d.rollup("l_returnflag", "l_linestatus")),
    ("cube", "CUBE (l_returnflag, l_linestatus)", lambda d: d.cube("l_returnflag", "l_linestatus")),
    ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus))", lambda d: d.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus")),
):

    @add(f"agg39_{key}", f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY {sql} HAVING count(*) > 10")
    def _(t, f=f):
        return f(t.lineitem).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).filter("n > 10").select("l_returnflag", "l_linestatus", "n", "q")


@add("agg40_partial_final", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), two(F.sum("l_extendedprice"), "sum_base"), two(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@add("agg41_sketches")
def _(t):
    return t.lineitem.agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@add("agg41_sketch_bounds", """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, true AS distinct_within, true AS median_within, true AS high_within FROM events GROUP BY 1""")
def _(t):
    """Distinct users and two quantiles of every month from sketches stored by day, held against exact values."""
    days, _ = materialise(sketches.daily(t.events, "ts", "event_id", "value"), "daily-sketches")
    found = sketches.estimates(sketches.merged(days.withColumn("month", F.date_format("day", "yyyy-MM")), "month"), 0.5, 0.95)
    rows = t.events.select(F.date_format("ts", "yyyy-MM").alias("month"), "event_id", "value").join(F.broadcast(found), "month")  # a row a month
    share = lambda q: (F.count_if(F.col("value") <= F.col(q)) / F.count("value"), F.count_if(F.col("value") < F.col(q)) / F.count("value"))
    within = lambda q, p: (share(q)[0] >= p - sketches.RANK_ERROR) & (share(q)[1] <= p + sketches.RANK_ERROR)
    exact = F.count_distinct("event_id")
    near = F.abs(F.first("distinct") - exact) <= sketches.DISTINCT_ERROR * exact
    return rows.groupBy("month").agg(F.first("rows").alias("rows"), near.alias("distinct_within"), within("q50", 0.5).alias("median_within"), within("q95", 0.95).alias("high_within"))


@add("agg42_leakage_columns", "SELECT unnest(['event_id', 'user_id']) AS \"column\"")
def _(t):
    return t.spark.createDataFrame([(c,) for c in core.leakage_candidates(t.events.columns, "event_type") if c != "event_type"], "`column` string")


@add("agg44_clean_sizes", f"WITH {GAPPY} SELECT 'before' AS step, count(*) AS n, 4 AS cols FROM gappy UNION ALL SELECT 'after', count(*), 3 FROM gappy")
def _(t):
    size = lambda d, s: d.agg(F.lit(s).alias("step"), F.count(F.lit(1)).alias("n"), F.lit(len(d.columns)).alias("cols"))
    return size(gappy(t), "before").unionByName(size(core.clean(gappy(t)), "after"))


@add("agg46_json_total", "SELECT user_id, sum(coalesce(json_extract(props, '$.k')::INTEGER, 0))::BIGINT AS total FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.sum(F.coalesce(F.from_json("props", "k int")["k"], F.lit(0))).alias("total"))


# --- windows and order ----------------------------------------------------------------------------------------------


@add("win1_rank_by_score", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def _(t):
    return t.part.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))


@add("win2_last_n_log", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10 ORDER BY user_id, ts")
def _(t):
    return core.first_n(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "ts").orderBy("user_id", "ts")


@add("win3_latest_one", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return core.first_n(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id")


@add("win4_running_balance", f"WITH {TRADES} SELECT account, symbol, ts, l_orderkey, l_linenumber, l_suppkey, sum(signed) OVER (PARTITION BY account, symbol ORDER BY ts, l_orderkey, l_linenumber, l_suppkey ROWS UNBOUNDED PRECEDING) AS position_after FROM trades")
def _(t):
    order = ["ts", "l_orderkey", "l_linenumber", "l_suppkey"]
    return ledger.running_position(trades(t), order).select("account", "symbol", *order, "position_after")


@add("win4_running_quantity", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS so_far FROM lineitem")
def _(t):
    """Three keys hold all rows: each is scanned over many tasks."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return scan.running(t.lineitem.select("l_returnflag", "l_quantity", *order), ["l_returnflag"], order, "l_quantity", "so_far", hot_rows=0).select(*order[1:], "so_far")


@add("win5_avg_cost")
def _(t):
    return ledger.average_cost(trades(t), ["ts", "l_orderkey", "l_linenumber", "l_suppkey"])


@add("win6_first_occurrence", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return core.first_n(t.documents, ["text"], [F.col("doc_id")], 1).select("text", "doc_id")


@add("win7_offered_load", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def _(t):
    sec = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(sec).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@add("win8_daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) <= 2 AS admitted FROM events")
def _(t):
    return activity.daily_quota(t.events, "user_id", "ts", 2).select("event_id", "admitted")


@add("win9_durations", "SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1")
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.groupBy("user_id").agg((F.max(us) - F.min(us)).alias("us"))


@add("win13_next_trading_day", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), t AS (SELECT day FROM d WHERE isodow(day) <= 5 AND month(day) * 100 + day(day) NOT IN (101, 619, 704, 1225))
  SELECT day, lead(day) OVER (PARTITION BY year(day) ORDER BY day) AS next_day FROM t""")
def _(t):
    from millrace.functions.dates import is_trading_day

    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().filter(is_trading_day(F.col("day")))
    return days.select("day", F.lead("day").over(Window.partitionBy(F.year("day")).orderBy("day")).alias("next_day"))


WF = "(PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)"
_w = lambda: Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
_keys = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]


@add("win14_rank_family", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS q FROM part")
def _(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("q"))


@add("win14_lag_lead", f"SELECT {', '.join(_keys)}, lag(l_quantity) OVER {WF} AS prev, lead(l_quantity, 2) OVER {WF} AS next2, first_value(l_quantity) OVER {WF} AS first FROM lineitem")
def _(t):
    return t.lineitem.select(*_keys, F.lag("l_quantity").over(_w()).alias("prev"), F.lead("l_quantity", 2).over(_w()).alias("next2"), F.first("l_quantity").over(_w()).alias("first"))


@add("win14_frames", f"SELECT {', '.join(_keys)}, sum(l_quantity) OVER {WF[:-1]} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, max(l_quantity) OVER {WF[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM lineitem")
def _(t):
    return t.lineitem.select(*_keys, F.sum("l_quantity").over(_w().rowsBetween(-2, 1)).alias("s"), F.max("l_quantity").over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("m"))


@add("srt1_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@add("srt2_order_by", "SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _(t):
    return t.orders.select("o_orderdate", "o_orderkey").orderBy(F.desc("o_orderdate"), "o_orderkey")


@add("srt5_smallest", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5")
def _(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey").limit(5)


@add("srt6_rank_map", "SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 4 END, event_id LIMIT 5")
def _(t):
    rank = F.create_map(F.lit("error"), F.lit(0), F.lit("purchase"), F.lit(1))
    return t.events.orderBy(F.coalesce(rank[F.col("event_type")], F.lit(4)), "event_id").limit(5).select("event_id")


@add("srt10_truncate", "SELECT doc_id, substr(text, 1, 500) AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("head"))


@add("srt11_score_sum", "SELECT p_partkey FROM part ORDER BY p_size + p_retailprice + p_partkey DESC, p_partkey LIMIT 7")
def _(t):
    return t.part.orderBy(F.desc(F.col("p_size") + F.col("p_retailprice") + F.col("p_partkey")), "p_partkey").limit(7).select("p_partkey")


# --- folds, ledger, streams in batch form ---------------------------------------------------------------------------


def _limiter(most: int, micros: int) -> str:
    young = f"list_filter(f.last, lambda x: e.t - x < {micros})"
    return f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
  f AS (SELECT user_id, t, n, true AS admitted, [t] AS last FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.t, e.n, len({young}) < {most}, CASE WHEN len({young}) < {most} THEN list_append({young}, e.t) ELSE f.last END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, make_timestamp(t) AS ts, admitted FROM f"""


def _utc(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@add("stm5_rate_limit", _limiter(2, 3_600_000_000))
def _(t):
    return _utc(activity.admit_rate(t.events, "user_id", "ts", 2, 3600))


@add("flt24_min_minutes", _limiter(1, 1_800_000_000))
def _(t):
    """A trade needs half an hour since the last accepted one."""
    return _utc(activity.admit_rate(t.events, "user_id", "ts", 1, 1800))


@add("stm6_cooldown", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
  f AS (SELECT user_id, t, n, NULL::VARCHAR AS reason, t AS last, 1 AS k FROM e WHERE n = 1 UNION ALL
  SELECT user_id, t, n, w, CASE WHEN w IS NULL THEN t ELSE last END, k + (w IS NULL)::INTEGER FROM (SELECT e.*, f.last, f.k,
    CASE WHEN trunc(3600 - (e.t - f.last) / 1000000.0::DOUBLE) > 0 THEN 'cooldown' WHEN f.k >= 5 THEN 'cap' END AS w
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)) SELECT user_id, make_timestamp(t) AS ts, reason FROM f""")
def _(t):
    return _utc(activity.admit_cooldown(t.events, "user_id", "ts", 3600, 5))


@add("stm11_content_cache", "SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return core.first_n(t.documents.select(F.sha2("text", 256).alias("h"), "doc_id"), ["h"], [F.col("doc_id")], 1).select("h", "doc_id")


@add("stm12_latest_checkpoint", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(t):
    return streams.latest_state(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn")


@add("stm12_time_travel", "SELECT conv_id, turn, role FROM conversations WHERE turn <= 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(t):
    return streams.state_at(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 1)


@add("stm13_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(t):
    return _plain(streams.tumbling(t.events, "ts", "1 hour", ["event_type"]))


@add("stm13_sliding", """SELECT s AS start, s + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM
  (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL""")
def _(t):
    return _plain(streams.sliding(t.events, "ts", "1 hour", "30 minutes", ["event_type"]))


@add("stm13_session", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events),
  s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def _(t):
    return _plain(streams.sessions(t.events, "ts", "2 hours", ["user_id"]))


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@add("stm4_alerts", "SELECT event_id, CASE WHEN value < 95 THEN 'warning' ELSE 'critical' END AS severity FROM events WHERE value > 80")
def _(t):
    return streams.alerts(t.events.select("event_id", F.lit("cpu").alias("kind"), "value")).select("event_id", "severity")


@add("ldg1_deposits", "SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice - 20000 > 0 THEN NULL ELSE 'amount' END AS reason FROM orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderkey", F.when(~(F.col("o_totalprice") - 20000 > 0), "amount").alias("reason"))


def _admitted(refuse: str, only: str = "") -> str:
    key = "ts, l_orderkey, l_linenumber, symbol, l_suppkey"
    return f"""WITH RECURSIVE {TRADES}, t AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY {key}, side, quantity, price) AS n FROM trades),
  f AS (SELECT account, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, NULL::BIGINT AS l_orderkey, NULL::INTEGER AS l_linenumber, NULL::BIGINT AS symbol, NULL::BIGINT AS l_suppkey,
    NULL::VARCHAR AS side, NULL::VARCHAR AS reason, 50000.0::DOUBLE AS cash, MAP {{-1::BIGINT: 0.0::DOUBLE}} AS held FROM (SELECT DISTINCT account FROM trades) UNION ALL
  SELECT account, n, {key}, side, w, CASE WHEN w IS NULL THEN cash + CASE WHEN side = 'buy' THEN -(price * 1.002::DOUBLE) * quantity ELSE price * 0.998::DOUBLE * quantity END ELSE cash END,
    CASE WHEN w IS NULL THEN map_concat(held, MAP {{symbol: have + signed}}) ELSE held END
  FROM (SELECT *, CASE WHEN quantity <= 0 THEN 'quantity' WHEN side = 'buy' AND price * 1.002::DOUBLE * quantity > cash THEN 'funds' WHEN side = 'buy' AND price = 0 THEN 'symbol'
    WHEN side = 'sell' AND {refuse} THEN 'holdings' END AS w FROM (SELECT t.*, f.cash, f.held, coalesce(f.held[t.symbol], 0.0::DOUBLE) AS have
    FROM f JOIN t ON t.account = f.account AND t.n = f.n + 1)))
  SELECT account, {key}, reason, cash AS balance_after FROM f WHERE n > 0 {only}"""


@add("ldg2_admit_funds", _admitted("have < quantity"))
def _(t):
    return ledger.admit_funds(trades(t), ["ts", "l_orderkey", "l_linenumber", "symbol", "l_suppkey"], 50_000.0)


@add("ldg3_sells", _admitted("have < quantity", "AND side = 'sell'"))
def _(t):
    """The decisions on sells, each after all trades of the account before it."""
    key = ["account", "ts", "l_orderkey", "l_linenumber", "symbol", "l_suppkey"]
    decided = ledger.admit_funds(trades(t).withColumn("kind", F.col("side")), [*key[1:], "kind"], 50_000.0)
    return decided.filter("kind = 'sell'").drop("kind")


@add("ldg4_admit_short", _admitted("have * price <= -1000"))
def _(t):
    return ledger.admit_funds(trades(t), ["ts", "l_orderkey", "l_linenumber", "symbol", "l_suppkey"], 50_000.0, short=True)


@add("ldg5_report", f"WITH {PROFIT} SELECT account, round(value, 2) AS total_portfolio_value, round(value - 10000, 2) AS total_profit_loss FROM p")
def _(t):
    """Reports as JSON, read again."""
    made = ledger.report(ledger.profit(trades(t), prices(t))).select(F.from_json("report", "account long, total_portfolio_value double, total_profit_loss double").alias("r"))
    return made.select("r.*")


@add("ldg6_bankrupt", f"WITH {PROFIT} SELECT account FROM p WHERE value <= 0")
def _(t):
    return ledger.profit(trades(t), prices(t)).filter("value <= 0").select("account")


@add("ldg7_pnl_vs_deposit", f"WITH {PROFIT} SELECT account, round(value - 10000, 2) AS pnl FROM p")
def _(t):
    return ledger.profit(trades(t), prices(t)).select("account", two(F.col("value") - 10000, "pnl"))


@add("ldg8_stock", """WITH RECURSIVE m AS (SELECT l_partkey AS product, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity AS quantity, coalesce(p_size * 10, 0)::DOUBLE AS on_hand,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
  f AS (SELECT *, quantity <= on_hand AS accepted, on_hand - CASE WHEN quantity <= on_hand THEN quantity ELSE 0 END AS rest FROM m WHERE n = 1 UNION ALL
  SELECT m.*, m.quantity <= f.rest, f.rest - CASE WHEN m.quantity <= f.rest THEN m.quantity ELSE 0 END FROM f JOIN m ON m.product = f.product AND m.n = f.n + 1)
  SELECT product, l_shipdate, l_orderkey, l_linenumber, l_suppkey, quantity, accepted, rest AS "left" FROM f""")
def _(t):
    moves = t.lineitem.select(F.col("l_partkey").alias("product"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("quantity"))
    return ledger.stock_after(moves, t.part.select(F.col("p_partkey").alias("product"), (F.col("p_size") * 10).alias("on_hand")), ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])


@add("ldg9_merge_items", "SELECT lower(trim(p_type)) AS key, sum(p_size)::BIGINT AS quantity, arg_min(p_brand, p_partkey) AS category, arg_min(p_retailprice, p_partkey) AS price FROM part GROUP BY 1")
def _(t):
    items = t.part.select(F.col("p_type").alias("name"), F.col("p_size").alias("quantity"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"), "p_partkey")
    return ledger.merge_items(items, ["p_partkey"]).drop("name")


@add("ldg10_counters", f"WITH {TRADES} SELECT account, side, count(*) AS n, sum(quantity) AS q FROM trades GROUP BY ALL")
def _(t):
    return trades(t).groupBy("account", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"))
