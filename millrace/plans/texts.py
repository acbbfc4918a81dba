"""Text, dates, numbers, nested values, hashes, chunking, retrieval and tool-surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import chunks as K
from millrace.operators import aggregate, core, similarity, sqlguard, tablefuncs, vectors
from millrace.operators.blockmax import bm25_best, bm25_best_of_tokens
from millrace.operators import retrieval as R
from millrace.operators.tools import Registry
from millrace.plans.base import Catalogue
from millrace.session import materialise
from millrace.sources import tables

C = Catalogue()
add = C.add
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"


_word, _blank = r"[\p{L}\p{M}\p{N}\p{Pc}]", r"[\s\x0b\x{85}\p{Z}]"
CLEAN = rf"regexp_replace(replace(coalesce(text, ''), chr(12), chr(10)), '({_word})-\n({_word})', '\1\2', 'g')"
for _old, _new in X.CLEAN_CHARS:
    CLEAN = "replace({}, '{}', '{}')".format(CLEAN, _old.replace("'", "''"), _new.replace("'", "''"))
for _old, _new in ((r"[ \t]+", "' '"), (rf"(?im)^[ \t]*page{_blank}+\p{{Nd}}+({_blank}+of{_blank}+\p{{Nd}}+)?[ \t]*$", "''"), (r"(?im)^[ \t]*confidential[ \t]*$", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (f"^{_blank}+|{_blank}+$", "''")):
    CLEAN = f"regexp_replace({CLEAN}, '{_old}', {_new}, 'g')"


@add("str1_sanitize", f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", X.clean(F.col("text")).alias("clean"))


@add("str2_meaningful", f"SELECT doc_id, length(trim(text, {WS})) >= 100 AS ok FROM documents")
def _(t):
    return t.documents.select("doc_id", X.meaningful(F.col("text")).alias("ok"))


@add("str3_text_stats", f"""SELECT doc_id, length(text) AS char_count, len({WORDS}) AS word_count,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS line_count FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("char_count"), X.word_count(F.col("text")).alias("word_count"), X.line_count(F.col("text")).alias("line_count"))


@add("str4_caption_clean", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def _(t):
    return t.pages.select("page_id", X.caption_clean(F.col("html")).alias("body"))


@add("str5_tokens", "SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''))) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(X.token_set(F.col("text"))).alias("n"))


@add("str6_lexical_tokens", f"SELECT doc_id, array_to_string({WORDS}, ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@add("str7_input_clean", """SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE
  trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script.*?</script>', '', 'g'), '[<>"'';}{]{3,}', '', 'g'), '\\s+', ' ', 'g')) END AS clean FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.input_clean(F.col("text")).alias("clean"))


@add("str8_emails", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), ',') AS emails FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0), ",").alias("emails"))


@add("str11_extension", "SELECT page_id, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '[^.]*$')) ELSE '' END AS ext FROM pages")
def _(t):
    return t.pages.select("page_id", X.extension(F.col("url")).alias("ext"))


@add("str12_human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE) WHEN n_chars IS NOT NULL THEN printf('%.1f MB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", X.human_size(F.col("n_chars")).alias("size"))


@add("str13_money", "SELECT p_partkey, format('{:,}', (p_size * 1000)::BIGINT) AS money FROM part")
def _(t):
    return t.part.select("p_partkey", F.format_number((F.col("p_size") * 1000).cast("double"), 0).alias("money"))


@add("str14_trace_ids", "SELECT c_custkey, regexp_extract('trace_' || c_name || '0abc', '^trace_([^0]*)', 1) AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.trace_name(F.concat(F.lit("trace_"), "c_name", F.lit("0abc"))).alias("name"))


@add("str15_first_json", "SELECT event_id, regexp_extract('noise ' || props || ' {x}', '(?s)(\\{.*?\\})', 1) AS j FROM events")
def _(t):
    return t.events.select("event_id", X.first_json(F.concat(F.lit("noise "), "props", F.lit(" {x}"))).alias("j"))


@add("str16_token_estimate", "SELECT doc_id, (length(text) // 4)::INTEGER AS tokens, length(text) // 4 <= 500 AS within FROM documents")
def _(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), (X.token_estimate(F.col("text")) <= 500).alias("within"))


_hits = lambda ws: " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws)


@add("str17_sentiment", f"WITH s AS (SELECT doc_id, {_hits(X.BULLISH)} AS u, {_hits(X.BEARISH)} AS d FROM documents) SELECT doc_id, CASE WHEN u > d * 1.5 THEN 'BULLISH' WHEN d > u * 1.5 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM s")
def _(t):
    return t.documents.select("doc_id", X.sentiment(F.col("text")).alias("label"))


@add("str21_normal_key", "SELECT DISTINCT lower(trim('  ' || c_mktsegment || ' ')) AS k FROM customer")
def _(t):
    return t.customer.select(X.normal_key(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("k")).distinct()


@add("str22_percent", "SELECT DISTINCT l_discount * 100 AS p FROM (SELECT DISTINCT round(l_discount * 100) / 100 AS l_discount FROM lineitem)")
def _(t):
    whole = t.lineitem.select((F.round(F.col("l_discount") * 100) / 100).alias("d")).distinct()
    return whole.select(X.percent(F.concat((F.col("d") * 100).cast("string"), F.lit("%"))).alias("p")).distinct()


@add("str23_error_lines", f"SELECT event_id, regexp_matches(upper(event_type), '{X.ERROR_PATTERN}') AS hit FROM events")
def _(t):
    return t.events.select("event_id", F.upper("event_type").rlike(X.ERROR_PATTERN).alias("hit"))


@add("str24_render_conversation", """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN text IS NULL OR text = '' THEN '[Tools use]' ELSE text END, chr(10) ORDER BY turn) AS body
  FROM conversations GROUP BY 1""")
def _(t):
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.when(F.coalesce(F.col("text"), F.lit("")) == "", "[Tools use]").otherwise(F.col("text")))
    rows = t.conversations.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("body"))


@add("str25_replacements", "SELECT n_nationkey, replace(replace(n_name, 'NATION', 'I am'), 'A', 'my') AS said FROM nation")
def _(t):
    return t.nation.select("n_nationkey", X.replace_all(F.col("n_name"), (("NATION", "I am"), ("A", "my"))).alias("said"))


@add("str26_trace_message", "SELECT event_id, concat_ws(' ', 'Ended', event_type, CASE WHEN event_type = 'error' THEN 'code ' || user_id END) AS message FROM events")
def _(t):
    return t.events.select("event_id", F.concat_ws(" ", F.lit("Ended"), "event_type", F.when(F.col("event_type") == "error", F.concat(F.lit("code "), "user_id"))).alias("message"))


@add("str27_safe_name", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '\\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g') || '_' || p_partkey AS name FROM part")
def _(t):
    return t.part.select("p_partkey", X.safe_name(F.col("p_type"), F.col("p_partkey")).alias("name"))


@add("str28_phone", "SELECT o_orderkey, CASE WHEN length(d) = 11 AND d[1] = '1' THEN substr(d, 2) ELSE d END AS phone FROM (SELECT o_orderkey, regexp_replace('+1 (555) ' || lpad(o_orderkey::VARCHAR, 7, '0'), '[^0-9]', '', 'g') AS d FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", X.phone_digits(F.concat(F.lit("+1 (555) "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))).alias("phone"))


ENT = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
for _old, _new in X.ENTITIES:
    ENT = f"replace({ENT}, '{_old}', '{_new.replace(chr(39), chr(39) * 2)}')"
HTML = f"regexp_replace(regexp_replace({ENT}, '(?i)</(p|div|h[1-6]|li|tr|br)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
HTML = f"regexp_replace(regexp_replace(regexp_replace({HTML}, '\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@add("str29_html_to_text", f"SELECT page_id, {HTML} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("body"))


PLAIN = "'# **T** _x_' || chr(10) || '| a | b |' || chr(10) || text"
for _old, _new in ((r"\*\*(.*?)\*\*", r"\1"), ("__(.*?)__", r"\1"), (r"\*(.*?)\*", r"\1"), ("_(.*?)_", r"\1"), (r"#+\s*", ""), (r"(?m)^\|.*\|$", "")):
    PLAIN = f"regexp_replace({PLAIN}, '{_old}', '{_new}', 'g')"
PLAIN = f"regexp_replace(replace({PLAIN}, '<br/>', chr(10)), '^{_blank}+|{_blank}+$', '', 'g')"


@add("str30_markdown", f"SELECT doc_id, {PLAIN} AS plain FROM documents")
def _(t):
    return t.documents.select("doc_id", X.markdown_plain(F.concat(F.lit("# **T** _x_\n| a | b |\n"), F.col("text"))).alias("plain"))


CATEGORIES = (("greeting", ("^the",)), ("number", (r"[0-9]{3}",)), ("mail", ("@",)))


@add("str31_category", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)^the') THEN 'greeting' WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' WHEN contains(text, '@') THEN 'mail' ELSE 'general' END AS c FROM documents")
def _(t):
    return t.documents.select("doc_id", X.first_category(F.col("text"), CATEGORIES).alias("c"))


@add("str32_numbered_names", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def _(t):
    """A numbered list per region is written, parsed again and matched to known names, unique and in order."""
    listed = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    body = listed.select("n_regionkey", F.array_join(F.transform("x", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["n_name"])), "\n").alias("body"))
    lines = body.select("n_regionkey", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    parsed = lines.select("n_regionkey", "pos", F.regexp_extract("line", r"^\s*\d+[.)]\s*(.+?)\s*$", 1).alias("n_name"))
    known = core.first_n(parsed.join(core.small(t.nation.select("n_name").distinct()), "n_name"), ["n_regionkey", "n_name"], ["pos"], 1)
    return known.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n_name"))), lambda r: r["n_name"]), ",").alias("names"))


@add("str33_readability", r"""WITH s AS (SELECT item_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS sentences,
  len(regexp_extract_all(lower(text), '[aeiouy]+')) AS syl FROM benchmark), f AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syl / words) AS v FROM s WHERE words > 0)
  SELECT item_id, words, sentences, round(v, 2) AS flesch, CASE WHEN v > 80 THEN 'Easy' WHEN v > 60 THEN 'Moderate' ELSE 'Hard' END AS level FROM f""")
def _(t):
    return t.benchmark.select("item_id", X.readability(F.col("text")).alias("r")).filter("r.words > 0").select("item_id", "r.*")


_dens = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)}" for k in X.SEO_KEYWORDS)


@add("str34_keyword_density", rf"SELECT item_id, round(({_dens}) / greatest(1, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) * 100, 2) AS density FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", X.keyword_density(F.col("text")).alias("density"))


_tone = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in X.TONES)


@add("str35_tone", f"SELECT doc_id, CASE {_tone} ELSE 'Neutral' END AS tone FROM documents")
def _(t):
    return t.documents.select("doc_id", X.tone(F.col("text")).alias("tone"))


@add("str36_reverse_title", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(reverse(n_name)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS x FROM nation")
def _(t):
    return t.nation.select("n_nationkey", X.reversed_title(F.col("n_name")).alias("x"))


# --- chunking -------------------------------------------------------------------------------------------------------


@add("chk1_word_windows", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
  i AS (SELECT doc_id, ws, unnest(range(0, len(ws), 450)) AS s FROM w) SELECT doc_id, (s // 450)::INTEGER AS chunk_idx, array_to_string(ws[s + 1 : s + 500], ' ') AS chunk FROM i""")
def _(t):
    return K.word_windows(t.documents.select("doc_id", "text"))


_packed = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, last) - 1)::INTEGER AS chunk_idx, chunk FROM (
  SELECT doc_id, n, 0 AS last, done AS chunk FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, n, 1, {rest} FROM f WHERE {open} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)"""
SENTENCES = r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\s+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]+\s+'), 1) AS i FROM documents WHERE text <> ''),
  o AS (SELECT doc_id, own, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS own FROM p) WHERE len(own) > 0),
  f AS (SELECT doc_id, n, own AS words, NULL::VARCHAR AS done FROM o WHERE n = 1 UNION ALL
  SELECT doc_id, n, CASE WHEN cut THEN list_concat(words[-100:], own) ELSE list_concat(words, own) END, CASE WHEN cut THEN array_to_string(words, ' ') END
  FROM (SELECT o.doc_id, o.n, o.own, f.words, len(f.words) + len(o.own) > 1000 AS cut FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)) """ + _packed.format(rest="array_to_string(words, ' ')", open="true")
TAILS = r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS s, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS i FROM documents WHERE text <> ''),
  o AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM p) WHERE s <> ''),
  f AS (SELECT doc_id, n, s AS body, NULL::VARCHAR AS done FROM o WHERE n = 1 UNION ALL
  SELECT doc_id, n, CASE WHEN cut THEN right(body, 200) ELSE body END || chr(10) || chr(10) || s, CASE WHEN cut THEN regexp_replace(body, '^\s+|\s+$', '', 'g') END
  FROM (SELECT o.doc_id, o.n, o.s, f.body, length(f.body) + length(o.s) > 1000 AS cut FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)) """ + _packed.format(rest=r"regexp_replace(body, '^\s+|\s+$', '', 'g')", open="true")

for key, f, sql in (
    ("chk2_paragraph_pack", K.paragraph_chunks, None), ("chk3_token_windows", K.token_chunks, None), ("chk4_sentence_pack", K.sentence_chunks, SENTENCES),
    ("chk5_tail_overlap", K.tail_chunks, TAILS), ("chk6_recursive", K.recursive_chunks, None),
):

    @add(key, sql)
    def _(t, f=f):
        return f(t.documents.select("doc_id", "text"))


@add("chk4_lateral_chunks", SENTENCES.replace("1000", "300").replace("words[-100:]", "words[-30:]"))
def _(t):
    """The sentence chunker as a table function of the guarded SQL surface."""
    tablefuncs.register(t.spark)
    t.documents.createOrReplaceTempView("chunked_documents")
    sql = "SELECT d.doc_id, c.chunk_idx, c.chunk FROM chunked_documents d, LATERAL chunk(d.text, 'sentences', 300, 30) c"
    return sqlguard.run(t.spark, sql, limit=None)


# --- dates ----------------------------------------------------------------------------------------------------------

ANCHOR = "DATE '1998-08-02'"


@add("dat1_years_to_maturity", f"SELECT o_orderkey, round(greatest(date_diff('day', {ANCHOR}, o_orderdate::DATE) / 365.25::DOUBLE, 0), 8) AS y FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(D.years_until(F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date")), 8).alias("y"))


@add("dat2_days_until", "SELECT o_orderkey, floor((epoch(o_orderdate)::BIGINT - 800000000) / 86400)::BIGINT AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.days_until(F.unix_timestamp("o_orderdate"), F.lit(800_000_000)).alias("d"))


@add("dat3_epoch_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.epoch_text(F.unix_timestamp("o_orderdate")).alias("s"))


@add("dat4_month_key", "SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(D.month_key(F.col("o_orderdate")).alias("m")).agg(F.count(F.lit(1)).alias("n"))


@add("dat5_month_year", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.month_year(F.date_format("o_orderdate", "MMM yyyy")).alias("m"))


@add("dat6_clock_seconds", "SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events")
def _(t):
    return t.events.select("event_id", D.clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("s"))


@add("dat7_coerce", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", raw.try_cast("date").alias("d"))


@add("dat8_looks_like_dates", "SELECT true AS dates, false AS names")
def _(t):
    return t.spark.createDataFrame([(core.looks_like_dates(t.orders, "o_orderdate"), core.looks_like_dates(t.orders, "o_orderpriority"))], "dates boolean, names boolean")


@add("dat10_trading_days", f"SELECT o_orderkey, trunc(date_diff('day', o_orderdate::DATE, {ANCHOR}) * 5 / 7)::INTEGER AS n FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.trading_days_between(F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date")).alias("n"))


@add("dat11_shift", "SELECT o_orderkey, o_orderdate::DATE + 45 AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 45).alias("d"))


@add("dat12_days_between", f"SELECT o_orderkey, date_diff('day', o_orderdate::DATE, {ANCHOR})::INTEGER AS n FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")).alias("n"))


@add("dat13_weekday", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INTEGER AS w, dayname(o_orderdate) AS name FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.weekday(F.to_date("o_orderdate")).alias("w"), F.date_format(F.to_date("o_orderdate"), "EEEE").alias("name"))


@add("dat15_iso_week", "SELECT o_orderkey, isoyear(o_orderdate)::INTEGER AS y, week(o_orderdate)::INTEGER AS w, isodow(o_orderdate)::INTEGER AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.extract(F.lit("YEAROFWEEK"), F.to_date("o_orderdate")).alias("y"), F.weekofyear(F.to_date("o_orderdate")).alias("w"), (F.weekday(F.to_date("o_orderdate")) + 1).alias("d"))


@add("dat16_strftime", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y at %H:%M') AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.strftime(F.col("o_orderdate"), "%d/%m/%Y at %H:%M").alias("s"))


@add("dat17_epoch", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS e FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.unix_timestamp("o_orderdate").alias("e"))


@add("dat19_next_weekday", "SELECT o_orderkey, o_orderdate::DATE + ((4 - (isodow(o_orderdate) - 1) + 7) % 7)::INTEGER AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.next_on_weekday(F.to_date("o_orderdate"), 4).alias("d"))


# --- numbers, nested values, hashes ---------------------------------------------------------------------------------


@add("mth1_swap_pnl", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((0.04::DOUBLE - 0.035::DOUBLE) * 10000) * (o_totalprice * 0.0001::DOUBLE * 5.0::DOUBLE), 2) AS pnl FROM orders""")
def _(t):
    side = F.when(F.col("o_orderkey") % 2 == 0, "RCV_FIXED").otherwise("PAY_FIXED")
    return t.orders.select("o_orderkey", F.round(N.swap_pnl(F.col("o_totalprice"), F.lit(0.035), F.lit(0.04), F.lit(5.0), side), 2).alias("pnl"))


@add("mth2_signal", "SELECT o_orderkey, CASE WHEN o_totalprice - 100000 >= 50000 OR o_totalprice - 100000 <= -25000 THEN 'CLOSE' ELSE 'HOLD' END AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", N.trade_signal(F.col("o_totalprice") - 100000).alias("s"))


@add("mth3_thresholds", """WITH n AS (SELECT o_orderkey, o_totalprice * 100 AS v FROM orders) SELECT o_orderkey, floor(round(v * CASE WHEN v >= 20000000 THEN 0.003::DOUBLE WHEN v >= 10000000 THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END * 1.2::DOUBLE, 2) / 10)::BIGINT AS target FROM n""")
def _(t):
    return t.orders.select("o_orderkey", F.floor(N.profit_target(F.col("o_totalprice") * 100) / 10).alias("target"))


@add("mth4_half_even", "SELECT p_partkey, round_even(p_size::DECIMAL(20,3) / 8, 2)::DOUBLE AS q FROM part")
def _(t):
    return t.part.select("p_partkey", N.quantise(F.col("p_size").cast("decimal(20,3)") / 8).cast("double").alias("q"))


@add("mth5_min_max", """SELECT p_partkey, round(CASE WHEN max(p_retailprice) OVER w = min(p_retailprice) OVER w THEN 0 ELSE (p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w) END, 8) AS s
  FROM part WINDOW w AS (PARTITION BY p_brand)""")
def _(t):
    return t.part.select("p_partkey", F.round(N.min_max(F.col("p_retailprice"), "p_brand"), 8).alias("s"))


@add("mth6_min_max_eps", """SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w + 1e-8), 8) AS a, round(p_size / (max(p_size) OVER w + 1e-8), 8) AS b FROM part WINDOW w AS (PARTITION BY p_brand)""")
def _(t):
    return t.part.select("p_partkey", F.round(N.min_max_eps(F.col("p_retailprice"), "p_brand"), 8).alias("a"), F.round(N.max_eps(F.col("p_size"), "p_brand"), 8).alias("b"))


@add("mth8_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def _(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("e")), 6).alias("c"))


@add("mth9_similarity", "SELECT p_partkey, round(1 / (1 + p_size::DOUBLE), 8) AS s FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(N.similarity(F.col("p_size").cast("double")), 8).alias("s"))


_set = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> ''))"


def _answer_sets(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.length("text").alias("n"), X.token_set(F.col("text")).alias("tokens"))
    return docs, t.benchmark.select(F.col("item_id").alias("item"), X.token_set(F.col("text")).alias("tokens"))


@add("mth10_answer_score", f"""WITH d AS (SELECT doc_id, {_set} AS w, length(text) AS n FROM documents), b AS (SELECT item_id, {_set} AS s FROM benchmark),
  j AS (SELECT doc_id, item_id, n, CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s, w)) / len(list_distinct(list_concat(s, w))) END AS j FROM d, b),
  c AS (SELECT *, CASE WHEN j >= 0.2 THEN least(1.0::DOUBLE, n / 300.0::DOUBLE) ELSE 0.3::DOUBLE END AS c FROM j),
  o AS (SELECT *, greatest(0, least(1, 0.3::DOUBLE * j + 0.4::DOUBLE * j + 0.15::DOUBLE * c + 0.15::DOUBLE * 1.0::DOUBLE)) AS o FROM c)
  SELECT doc_id, item_id, round(j, 3) AS relevance, round(j, 3) AS accuracy, round(c, 3) AS completeness, 1.0::DOUBLE AS consistency, round(o, 3) AS overall, o >= 0.7 AS passed FROM o""")
def _(t):
    docs, items = _answer_sets(t)
    met = similarity.stated_overlaps(docs, items)
    if met is None:  # more items than a task takes
        score = N.answer_score(F.col("s"), F.col("s"), F.col("tokens"), F.array().cast("array<string>"), F.col("n"))
        pairs = core.with_each(docs, items.select("item", F.col("tokens").alias("s")))
        return pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), score.alias("r")).select("doc_id", "item_id", "r.*")
    j = met.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n", similarity.overlap_jaccard().alias("j"))
    score = N.answer_marks(F.col("j"), F.col("j"), F.lit(1.0), F.col("n"))
    return j.select("doc_id", "item_id", score.alias("r")).select("doc_id", "item_id", "r.*")


@add("mth10_passing_answers", f"""WITH d AS (SELECT doc_id, {_set} AS w, length(text) AS n FROM documents), b AS (SELECT item_id, {_set} AS s FROM benchmark),
  j AS (SELECT doc_id, item_id, n, CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s, w)) / len(list_distinct(list_concat(s, w))) END AS j FROM d, b),
  o AS (SELECT *, CASE WHEN j >= 0.2 THEN least(1.0::DOUBLE, n / 300.0::DOUBLE) ELSE 0.3::DOUBLE END AS c, 0.3::DOUBLE * j + 0.4::DOUBLE * j + 0.15::DOUBLE * c + 0.15::DOUBLE * 1.0::DOUBLE AS o FROM j),
  p AS (SELECT item_id, doc_id, round(j, 3) AS relevance, round(c, 3) AS completeness, round(o, 3) AS overall FROM o WHERE o >= 0.7)
  SELECT b.item_id, p.doc_id, relevance, completeness, overall, (SELECT count(*) FROM documents) - count(p.doc_id) OVER (PARTITION BY b.item_id) AS failed FROM b LEFT JOIN p ON b.item_id = p.item_id""")
def _(t):
    """Documents that pass as an answer to an item, and how many don't; an item that none answers has one row. The mark can
    only be reached from a similarity of 4/7 on, so a similarity join finds all that reach it."""
    docs, items = _answer_sets(t)
    met = similarity.stated_overlaps(docs, items, 0.5714)
    if met is None:  # more items than a task takes
        (reps, _), (members, _) = (materialise(x, "token-sets") for x in similarity.classes(docs))
        sets = items.filter(F.size("tokens") > 0).select(F.col("item").alias("id"), "tokens")
        found = similarity.set_join(reps, sets, 0.5714).select(F.col("a").alias("class"), F.col("b").alias("item_id"), F.col("jaccard").alias("j"))
        pairs = found.join(members, "class").join(docs.select("id", "n"), "id")
    else:
        pairs = met.select("id", "n", F.col("item").alias("item_id"), similarity.overlap_jaccard().alias("j"))
    c = F.least(F.lit(1.0), F.col("n") / 300.0)
    overall = 0.3 * F.col("j") + 0.4 * F.col("j") + 0.15 * c + 0.15 * F.lit(1.0)
    rounded = [F.round(x, 3).alias(n) for x, n in ((F.col("j"), "relevance"), (c, "completeness"), (overall, "overall"))]
    passed, _ = materialise(pairs.filter(overall >= 0.7).select("item_id", F.col("id").alias("doc_id"), *rounded), "passed")
    counts = passed.groupBy("item_id").agg(F.count(F.lit(1)).alias("passed"))
    total = t.documents.agg(F.count(F.lit(1)).alias("total"))  # one row
    every = t.benchmark.select("item_id").join(counts, "item_id", "left").crossJoin(F.broadcast(total))
    failed = (F.col("total") - F.coalesce("passed", F.lit(0))).alias("failed")
    return every.select("item_id", failed).join(passed, "item_id", "left")


@add("mth12_bands", "SELECT event_id, CASE WHEN value - 50 > 0.1 THEN 'Positive' WHEN value - 50 < -0.1 THEN 'Negative' ELSE 'Neutral' END AS b FROM events")
def _(t):
    return t.events.select("event_id", N.band(F.col("value") - 50, 0.1).alias("b"))


@add("mth14_severity", "SELECT event_id, CASE WHEN value > 85 THEN CASE WHEN value < 90 THEN 'warning' ELSE 'critical' END END AS s FROM events")
def _(t):
    return t.events.select("event_id", N.severity(F.col("value"), "memory").alias("s"))


@add("mth15_grade", "SELECT event_id, CASE WHEN value >= 85 THEN 'Excellent' WHEN value >= 70 THEN 'Good' WHEN value >= 50 THEN 'Fair' ELSE 'Needs Improvement' END AS g FROM events")
def _(t):
    return t.events.select("event_id", N.grade(F.col("value")).alias("g"))


@add("mth16_first_score", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END, 0), nullif(p_retailprice, 0)) AS s FROM part")
def _(t):
    v3 = F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_size").cast("double"))
    return t.part.select("p_partkey", N.first_score(v3, F.col("p_retailprice")).alias("s"))


_unit = "list_transform({0}.embedding, lambda x: x::DOUBLE / sqrt(list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[])))"


@add("mth17_same_entity", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0 WHERE list_inner_product({_unit.format('a')}, {_unit.format('b')}) > 0.5")
def _(t):
    """The stated query vectors against all others: unit vectors whose product is above a half."""
    found = vectors.over(*stated_vectors(t), 0.5)
    return found.filter("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"))


@add("nst1_json", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@add("nst2_map_default", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'none' END AS v FROM nation")
def _(t):
    m = F.create_map(F.lit(0), F.lit("zero"), F.lit(1), F.lit("one"))
    return t.nation.select("n_nationkey", F.coalesce(F.try_element_at(m, F.col("n_regionkey")), F.lit("none")).alias("v"))


@add("nst3_drop_at_zero", "SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) <> 0")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("n")).filter("n <> 0")


@add("nst4_append_flatten", "SELECT n_nationkey, n_name || ',' || n_regionkey || ',end,x,x' AS v FROM nation")
def _(t):
    base = F.array_append(F.array("n_name", F.col("n_regionkey").cast("string")), F.lit("end"))
    return t.nation.select("n_nationkey", F.array_join(F.flatten(F.array(base, F.array_repeat(F.lit("x"), 2))), ",").alias("v"))


@add("nst7_comprehension", "SELECT conv_id, array_to_string(list_transform(list_filter(list(turn ORDER BY turn), lambda x: x % 2 = 0), lambda x: x * 10), ',') AS v, bool_or(turn > 2) AS some, bool_and(turn >= 0) AS every FROM conversations GROUP BY 1")
def _(t):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("a"))
    v = F.transform(F.filter("a", lambda x: x % 2 == 0), lambda x: x * 10)
    return g.select("conv_id", F.array_join(v.cast("array<string>"), ",").alias("v"), F.exists("a", lambda x: x > 2).alias("some"), F.forall("a", lambda x: x >= 0).alias("every"))


@add("nst9_list_text", "SELECT n_nationkey, n_name AS a, n_regionkey::VARCHAR AS b FROM nation")
def _(t):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('["'), "n_name", F.lit('","'), "n_regionkey", F.lit('"]'))).otherwise(F.concat_ws(",", "n_name", "n_regionkey"))
    parsed = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.split(raw, ","))
    return t.nation.select("n_nationkey", parsed[0].alias("a"), parsed[1].alias("b"))


@add("nst10_merge_structs", "SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey FROM supplier")
def _(t):
    s = t.supplier.select(F.struct("s_suppkey", "s_name", "s_nationkey").alias("a"))
    return s.select(F.col("a").withField("s_name", F.upper("a.s_name")).alias("a")).select("a.*")


@add("hsh1_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@add("hsh2_md5_prefix", "SELECT c_custkey, substr(md5(c_name), 1, 16) AS h FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.substring(F.md5("c_name"), 1, 16).alias("h"))


@add("hsh3_sha1", "SELECT doc_id, sha1(text) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha1("text").alias("h"))


@add("hsh4_stable_id", "SELECT count(DISTINCT source || chr(0) || text) AS n FROM documents")
def _(t):
    return t.documents.agg(F.countDistinct(F.xxhash64("source", "text")).alias("n"))


# --- retrieval ------------------------------------------------------------------------------------------------------

BM25 = """d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents),
  p AS (SELECT id, len(ws) AS len, unnest(ws) AS term FROM d), tf AS (SELECT id, term, len, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  gs AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
  q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), gs GROUP BY ALL)"""
DENSE = """v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS score FROM embeddings a, embeddings b WHERE {which})"""
ITEMS, STATED = "a.vec_id IN (SELECT item_id FROM benchmark)", "a.vec_id % 100 = 0"


def bm25(t):
    """Scores for all benchmark items."""
    return R.bm25(t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def lexical(t, k, items=1):
    """The k best documents of every benchmark item, or of ``items`` successive ones together."""
    q = t.benchmark.select(F.floor(F.col("item_id") / items).alias("query_id"), F.col("text").alias("query"))
    return R.top(rounded(bm25_best(t.documents.select(F.col("doc_id").alias("id"), "text"), q, k)), k)


def with_documents(t, found, *columns):
    """``found`` (by ``id``) with columns of its documents. What a search found is written once, and where it is small it goes to
    the documents, so that their texts are not shuffled."""
    kept, _ = materialise(found, "found")
    return t.documents.select(F.col("doc_id").alias("id"), *columns).join(core.small(kept), "id")


def dense_best(t, k):
    """The k nearest vectors of those of all benchmark items, by cosine to eight places. Where either vector is null so is the score,
    and such pairs come last, by id."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.join(core.small(t.benchmark.select(F.col("item_id").alias("id")).distinct()), "id", "left_semi")
    first = lambda rows: F.broadcast(rows.select("id").orderBy("id").limit(k))
    q = asked.withColumnRenamed("id", "query_id")
    unscored = q.filter("v IS NOT NULL").crossJoin(first(v.filter("v IS NULL"))).unionByName(q.filter("v IS NULL").crossJoin(first(v)))
    found = rounded(vectors.nearest(v, asked, k)).unionByName(unscored.select("query_id", "id", F.lit(None).cast("double").alias("score")))
    return core.first_n(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def stated_vectors(t):
    """All vectors, and those whose id is divisible by 100."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.filter("id % 100 = 0")


def dense_top(t, k):
    """The k nearest vectors of the stated ones, by cosine to eight places."""
    found = rounded(vectors.nearest(*stated_vectors(t), k))
    return core.first_n(found, ["query_id"], [F.desc("score"), F.col("id")], k)


TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, id)"


def rounded(df):
    return df.withColumn("score", F.round("score", 8))


@add("ret1_index", """SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL""")
def _(t):
    return R.postings(t.documents, "doc_id")


@add("ret2_bm25_topk", "WITH " + BM25 + f" SELECT query_id, id, round(score, 8) AS score, {TOP} AS rank FROM s WHERE score > 0 QUALIFY {TOP} <= 10")
def _(t):
    return lexical(t, 10)


@add("ret3_dense_topk", "WITH " + DENSE.format(which=STATED) + f" SELECT query_id, id, score, {TOP} AS rank FROM v QUALIFY {TOP} <= 10")
def _(t):
    return dense_top(t, 10)


@add("ret4_dense_cutoff", "WITH " + DENSE.format(which=STATED) + " SELECT query_id, id FROM v WHERE 1 - score < 0.75")
def _(t):
    return rounded(vectors.above(*stated_vectors(t), 0.25)).filter(1 - F.col("score") < 0.75).select("query_id", "id")


NORM = "CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 0 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END"
HYBRID = f"""l AS (SELECT query_id, id, {NORM} AS x FROM (SELECT query_id, id, round(score, 8) AS score FROM s QUALIFY {TOP} <= 20)),
  m AS (SELECT query_id, id, {NORM} AS y FROM (SELECT query_id, id, score FROM v QUALIFY {TOP} <= 20)),
  h AS (SELECT coalesce(l.query_id, m.query_id) AS query_id, coalesce(l.id, m.id) AS id, round(0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0), 8) AS score FROM l FULL JOIN m ON l.query_id = m.query_id AND l.id = m.id)"""


def hybrid(t, k=10):
    both = R.hybrid(lexical(t, 4 * k).drop("rank"), dense_best(t, 4 * k).drop("rank"), 2 * k)
    return core.first_n(rounded(both.drop("rank")), ["query_id"], [F.desc("score"), F.col("id")], k)


@add("ret5_hybrid", "WITH " + BM25 + ", " + DENSE.format(which=ITEMS) + ", " + HYBRID.replace("<= 20", "<= 40") + f" SELECT query_id, id, score FROM h QUALIFY {TOP} <= 10")
def _(t):
    return hybrid(t).select("query_id", "id", "score")


@add("ret6_full_corpus", "WITH " + BM25 + " SELECT query_id, id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8), 6) AS score FROM s WINDOW w AS (PARTITION BY query_id)")
def _(t):
    s = bm25(t)
    return s.select("query_id", "id", F.round(N.min_max_eps(F.col("score"), "query_id"), 6).alias("score"))


@add("ret7_multi_query", "WITH " + BM25 + f", g AS (SELECT query_id // 2 AS query_id, id, sum(score) AS score FROM s GROUP BY 1, 2) SELECT query_id, id, round(score, 8) AS score FROM g QUALIFY {TOP} <= 5")
def _(t):
    """Both items of a question add up: its terms count as often as both hold them."""
    return lexical(t, 5, items=2).select("query_id", "id", "score")


_list = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"
OVERLAP = f"""CASE WHEN len({_list.format('b.text')}) > 0 THEN len(list_intersect({_list.format('b.text')}, {_list.format('d.text')})) / len({_list.format('b.text')}) ELSE 0.0 END"""
FIRST = f"r AS (SELECT query_id, id, {TOP} AS rank FROM s WHERE round(score, 8) > 0 QUALIFY {TOP} <= {{k}})"
RERANKED = f"o AS (SELECT query_id, id, {OVERLAP} AS score FROM r JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id)"
BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


@add("ret8_rerank", f"WITH {BM25}, {FIRST.format(k=15)}, {RERANKED} SELECT query_id, id, score, {BEST} AS rank FROM o QUALIFY rank <= 5")
def _(t):
    top = lexical(t, 15)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    both = with_documents(t, top, "text").join(core.small(q), "query_id")
    return R.rerank(both, R.lexical_overlap(F.col("query"), F.col("text")), 5).select("query_id", "id", "score", "rank")


@add("ret9_multi_query_first", "WITH " + BM25 + f", r AS (SELECT query_id, id, {TOP} AS rank FROM s QUALIFY {TOP} <= 10) SELECT query_id // 2 AS question, id, arg_min(query_id, (query_id, rank)) AS variant FROM r GROUP BY 1, 2")
def _(t):
    r = lexical(t, 10).withColumn("question", F.floor(F.col("query_id") / 2))
    return R.first_seen(r, "question", ["query_id", "rank"]).select("question", "id", F.col("query_id").alias("variant"))


@add("ret10_context", "SELECT doc_id, '[1] ' || coalesce(source, 'unknown') || chr(10) || text AS context FROM documents")
def _(t):
    return t.documents.select("doc_id", R.context(F.lit(1), F.col("source"), F.col("text")).alias("context"))


REL = "rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def relevant(t):
    items = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.containing(t.documents.select(F.col("doc_id").alias("id"), "text"), items).withColumn("gain", F.lit(1.0))


@add("ret11_metrics", "WITH " + BM25 + f""", {REL}, r AS (SELECT query_id, id, {TOP} AS rank FROM s WHERE score > 0 QUALIFY {TOP} <= 10),
  g AS (SELECT rel.query_id, count(DISTINCT rel.id) AS n, min(r.rank) AS first, count(r.rank) AS hits, coalesce(sum(1 / log2(r.rank + 1)), 0) AS dcg FROM rel LEFT JOIN r ON rel.query_id = r.query_id AND rel.id = r.id GROUP BY 1)
  SELECT query_id, round(coalesce(1 / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, hits / 10 AS precision, round(hits / n, 6) AS recall FROM g""")
def _(t):
    q = R.quality(lexical(t, 10), relevant(t), 10)
    return q.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "precision", "recall")])


def method_report(t, k=10):
    """Mean quality of four retrieval methods over all benchmark items."""
    rel, _ = materialise(relevant(t), "relevant")
    first, _ = materialise(lexical(t, 4 * k), "lexical")
    near = dense_best(t, 4 * k)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = t.documents.select(F.col("doc_id").alias("id"), "text").join(core.small(first), "id").join(core.small(q), "query_id")
    both = core.first_n(rounded(R.hybrid(first.drop("rank"), near.drop("rank"), 2 * k).drop("rank")), ["query_id"], [F.desc("score"), F.col("id")], k)
    methods = {"bm25": first.filter(F.col("rank") <= k), "semantic": near.filter(F.col("rank") <= k), "hybrid": both, "rerank": R.rerank(pairs, R.lexical_overlap(F.col("query"), F.col("text")), k)}
    out = None
    for name, ranked in methods.items():
        one = R.quality(ranked.select("query_id", "id", "rank"), rel, k).select(F.lit(name).alias("method"), "mrr", "ndcg", "precision", "recall")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("method").agg(F.round(F.avg("mrr"), 3).alias("mrr"), F.round(F.stddev_samp("mrr"), 3).alias("mrr_sd"), *[F.round(F.avg(c), 3).alias(c) for c in ("ndcg", "precision", "recall")])


def _sweep_sql(size: int) -> str:
    """Mean reciprocal rank of one chunk size."""
    step = size - size // 10
    return f"""(WITH c AS (SELECT doc_id, unnest(range(0, len(ws), {step})) AS i, ws FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents)),
  d AS (SELECT doc_id || '_' || (i // {step}) AS id, ws[i + 1 : i + {size}] AS ws FROM c), {BM25[BM25.index('p AS'):]},
  r AS (SELECT query_id, string_split(id, '_')[1]::BIGINT AS id, {TOP} AS rank FROM s WHERE round(score, 8) > 0 QUALIFY {TOP} <= 5), {REL},
  g AS (SELECT rel.query_id, min(r.rank) AS first FROM rel LEFT JOIN r ON rel.query_id = r.query_id AND rel.id = r.id GROUP BY 1)
  SELECT {size} AS size, round(avg(coalesce(1 / first, 0)), 4) AS mrr FROM g)"""


SIZES = (100, 200, 400)


@add("ret12_sweep", f"WITH m AS ({' UNION ALL '.join('SELECT * FROM ' + _sweep_sql(n) for n in SIZES)}) SELECT size, mrr, size = (SELECT arg_max(size, (mrr, -size)) FROM m) AS best FROM m")
def _(t):
    """Chunk size by mean reciprocal rank of the containing chunk; the best one is marked."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    (rel, _), out = materialise(relevant(t), "relevant"), None
    for size in SIZES:
        c = K.token_windows(t.documents.select("doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("ws")), "ws", size=size, overlap=size // 10)
        top = R.top(rounded(bm25_best_of_tokens(c.select(F.concat_ws("_", "doc_id", "chunk_idx").alias("id"), "ws"), q, 5)), 5)
        hit = top.withColumn("id", F.split("id", "_")[0].cast("long")).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        one = R.quality(hit, rel, 5).agg(F.lit(size).alias("size"), F.round(F.avg("mrr"), 4).alias("mrr"))
        out = one if out is None else out.unionByName(one)
    best = out.agg(F.max_by("size", F.struct("mrr", -F.col("size"))).alias("b"))  # one row
    return out.crossJoin(F.broadcast(best)).select("size", "mrr", (F.col("size") == F.col("b")).alias("best"))


@add("ret13_method_report", f"""WITH {BM25}, {DENSE.format(which=ITEMS)}, {REL}, {HYBRID.replace("<= 20", "<= 40")}, {FIRST.format(k=30)}, {RERANKED},
  a AS (SELECT 'bm25' AS method, query_id, id, rank FROM r WHERE rank <= 10 UNION ALL SELECT 'semantic', query_id, id, {TOP} AS rank FROM v QUALIFY {TOP} <= 10 UNION ALL
    SELECT 'hybrid', query_id, id, {TOP} AS rank FROM h QUALIFY {TOP} <= 10 UNION ALL SELECT 'rerank', query_id, id, {BEST} AS rank FROM o QUALIFY {BEST} <= 10),
  g AS (SELECT m.method, rel.query_id, count(DISTINCT rel.id) AS n, min(a.rank) AS first, count(a.rank) AS hits, coalesce(sum(1 / log2(a.rank + 1)), 0) AS dcg
    FROM (SELECT DISTINCT method FROM a) m CROSS JOIN rel LEFT JOIN a ON a.method = m.method AND a.query_id = rel.query_id AND a.id = rel.id GROUP BY 1, 2),
  z AS (SELECT method, coalesce(1 / first, 0) AS mrr, dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, hits / 10 AS precision, hits / n AS recall FROM g)
  SELECT method, round(avg(mrr), 3) AS mrr, round(stddev_samp(mrr), 3) AS mrr_sd, round(avg(ndcg), 3) AS ndcg, round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall FROM z GROUP BY 1""")
def _(t):
    return method_report(t)


# --- tool surface ---------------------------------------------------------------------------------------------------


def registry(t) -> Registry:
    r = Registry()

    @r.tool
    def balance(spark, name: str, least: float = 0.0):
        c = tables.table(spark, t.sf_dir, "customer")
        return c.filter((F.lower("c_name") == name.lower()) & (F.col("c_acctbal") >= least)).select("c_custkey", "c_acctbal")

    @r.resource("accounts://holder/{name}")
    def holder(spark, name):
        return balance(spark, name, -1e9)

    return r


@add("udf1_tool_call", "SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000007' AND c_acctbal >= -1000000")
def _(t):
    return registry(t).call(t.spark, "balance", name="customer#000000007", least=-1e6)


@add("udf3_resource", "SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000009'")
def _(t):
    return registry(t).read(t.spark, "accounts://holder/Customer#000000009")


@add("udf7_guarded_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 ORDER BY 1 LIMIT 100")
def _(t):
    t.nation.createOrReplaceTempView("guarded_nation")
    return sqlguard.run(t.spark, "WITH x AS (SELECT n_regionkey, count(*) AS n FROM guarded_nation GROUP BY 1) SELECT * FROM x ORDER BY 1;")


@add("udf12_ordered_reducer", "SELECT conv_id, len(list(text))::INTEGER AS n, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def _(t):
    return aggregate.aggregate(t.conversations, ["conv_id"], ["turn", "role"], aggregate.last_message())
