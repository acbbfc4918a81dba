"""Lexical, dense and hybrid retrieval, and ranking quality: postings, joins and windows; only a pluggable model is a UDF."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import cosine, min_max
from millrace.functions.text import tokens
from millrace.operators.core import first_n, is_small, small, with_each

K1, B = 1.5, 0.75


def postings(chunks: DataFrame, chunk_id: str = "id", text: str = "text") -> DataFrame:
    """``term, id, tf``."""
    words = chunks.select(F.col(chunk_id).alias("id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, chunk_id: str = "id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``query_id, id, score`` of every chunk that shares a term, Okapi BM25 with idf = ln(1 + (N - df + 0.5)/(df + 0.5)).

    Texts are cut into terms once and dealt by chunk, reduced to the queries' terms: the only shuffle. Term counts, the
    queries' terms with their document frequencies (broadcast where the queries are small) and the sums of a chunk for
    each query all follow that partitioning. Chunk ids are unique.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term"))
    q = wanted.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    few = is_small(q)
    sized = F.broadcast if few else (lambda x: x)
    cut = chunks.select(F.col(chunk_id).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("ws"))
    total = cut.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ws")).alias("avg_len"))  # one row
    words = cut.select("id", F.size("ws").alias("len"), F.explode("ws").alias("term"))
    dealt = words.join(sized(q.select("term").distinct()), "term", "left_semi").repartition("id")
    hits = dealt.groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    asked = q.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")  # as many rows as q at most
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.join(sized(asked), "term").crossJoin(F.broadcast(total))
    return scored.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * part).alias("score"))


def top(scores: DataFrame, k: int, by: str = "query_id", item: str = "id") -> DataFrame:
    """Best k of each query, score above 0, ties by id."""
    return first_n(scores.filter("score > 0"), [by], [F.desc("score"), F.col(item)], k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vec: str = "embedding", most: float | None = None) -> DataFrame:
    """Exact scan: ``query_id, id, score, rank`` by cosine of a bounded query set against all vectors. ``queries`` is
    ``query_id, qv``; ``most`` is a cosine-distance limit."""
    q = queries.select("query_id", F.col("qv"))
    pairs = with_each(vectors.select(F.col(vec_id).alias("id"), F.col(vec).alias("v")), q).select("query_id", "id", cosine(F.col("qv"), F.col("v")).alias("score"))
    if most is not None:
        pairs = pairs.filter(1 - F.col("score") < most)
    return first_n(pairs, ["query_id"], [F.desc("score"), F.col("id")], k)


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int, lexical_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """Top 2k of each side, scaled per query, outer-merged with 0 for what is missing, weighted, top k."""
    one = top(lexical, 2 * k).select("query_id", "id", min_max(F.col("score"), "query_id").alias("l"))
    two = first_n(semantic, ["query_id"], [F.desc("score"), F.col("id")], 2 * k).select("query_id", "id", min_max(F.col("score"), "query_id").alias("s"))
    both = one.join(two, ["query_id", "id"], "full")
    score = lexical_weight * F.coalesce("l", F.lit(0.0)) + semantic_weight * F.coalesce("s", F.lit(0.0))
    return first_n(both.select("query_id", "id", score.alias("score")), ["query_id"], [F.desc("score"), F.col("id")], k)


def multi_query(scores: DataFrame, group: str, k: int) -> DataFrame:
    """Scores of a question's variants add up per document."""
    total = scores.groupBy(group, "id").agg(F.sum("score").alias("score"))
    return first_n(total, [group], [F.desc("score"), F.col("id")], k)


def first_seen(ranked: DataFrame, group: str, order: list) -> DataFrame:
    """One row per document of a question: the one met first over (variant, method, rank)."""
    return first_n(ranked, [group, "id"], order, 1, "__r").drop("__r")


def rerank(ranked: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Best 3k candidates rescored by a pluggable expression (a pandas UDF fits), then the best k."""
    some = ranked.filter(F.col("rank") <= 3 * k).withColumn("score", scorer)
    return first_n(some.drop("rank"), ["query_id"], [F.desc("score"), F.col("id")], k)


def model_scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A model that scores lists of (query, text) pairs, as a column expression on Arrow batches; null texts are empty."""

    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return F.pandas_udf(scored, "double")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default pair scorer: share of the query's distinct tokens that the text holds."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def context(rank: Column, source: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(source, F.lit("unknown"))), text)


def quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, mrr, ndcg, ndcg_retrieved, precision, recall`` of each query with relevant documents.

    ``ranked`` is ``query_id, id, rank``; ``relevant`` is ``query_id, id, gain``. ``ndcg`` divides by the ideal of all
    gains, ``ndcg_retrieved`` by the best order of the retrieved ones; precision divides by k.
    """
    g = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    found = g.groupBy("query_id").agg(
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.count_if(F.col("gain") > 0).alias("hits"),
        F.sort_array(F.collect_list("gain"), asc=False).alias("own"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    ideal = relevant.withColumn("r", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1))).alias("ideal"), F.count_if(F.col("gain") > 0).alias("n")
    )
    own = F.aggregate(F.transform("own", lambda x, i: x / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = ideal.join(found, "query_id", "left").fillna(0, ["dcg", "hits"])
    return out.select(
        "query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), share(F.col("dcg"), F.col("ideal")).alias("ndcg"),
        F.coalesce(share(F.col("dcg"), own), F.lit(0.0)).alias("ndcg_retrieved"), (F.col("hits") / k).alias("precision"), share(F.col("hits"), F.col("n")).alias("recall"),
    )


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``query_id, id``: documents (``id, text``) whose text holds an item's (``query_id, query``) as a substring.

    Every blank-separated token inside an item stands whole in any text that holds it, so the item's rarest one fetches the
    candidates by an equi-join and only those are searched. Items of one or two tokens are held against every document.
    """
    pieces = lambda c: F.split(c, r"(?U)\s+")
    cut = items.filter("query <> ''").select("query_id", "query", pieces(F.col("query")).alias("p"))
    inner = cut.select("query_id", "query", F.filter("p", lambda x, i: (i > 0) & (i < F.size("p") - 1) & (x != "")).alias("inner"))
    words = docs.select("id", F.explode(F.array_distinct(pieces(F.col("text")))).alias("token"))
    asked = inner.select("query_id", F.explode("inner").alias("token")).distinct()
    seen = words.join(small(asked.select("token").distinct()), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    anchors = asked.join(counts, "token").groupBy("query_id").agg(F.min(F.struct("n", "token")).alias("a")).select("query_id", F.col("a.token").alias("token"))
    if is_small(items):  # an anchor an item at most: the items go to the documents, which are searched where they are
        fetched = F.broadcast(anchors.join(items, "query_id"))
        searched = docs.select("id", "text", F.explode(F.array_distinct(pieces(F.col("text")))).alias("token")).join(fetched, "token")
    else:
        searched = seen.join(anchors, "token").select("query_id", "id").join(docs, "id").join(items, "query_id")
    short = with_each(docs, inner.filter(F.size("inner") == 0).select("query_id", "query"))
    cols = ["query_id", "id", "query", "text"]
    return searched.select(cols).unionByName(short.select(cols)).filter(F.contains("text", "query")).select("query_id", "id").distinct()


def keyword_coverage(keywords: Column, texts: Column) -> Column:
    """Per cent of the keywords that occur, case aside, in any of the texts."""
    low = F.lower(F.array_join(texts, "\n"))
    return F.when(F.size(keywords) > 0, 100.0 * F.size(F.filter(keywords, lambda w: F.contains(low, F.lower(w)))) / F.size(keywords)).otherwise(0.0)
