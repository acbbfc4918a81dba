"""Ranked lexical search, score at a time over impact-ordered postings.

A term's weight w and its impact in a document are whole numbers, so a posting adds w * impact exactly. One pass over the texts
writes, for every slice of documents, the postings of the terms that the queries hold; document frequencies, the number of
documents and their length are summed from what it wrote. Each task of the search then orders its postings by term and exact
impact, and for every query takes the groups of equal impact of all its terms in descending order, adding to one accumulator a
document. The highest contributions not yet taken bound what any document can still gain: the scan stops once no document that
it hasn't met can reach the k-th score found so far (in this or an earlier slice of the task), and the scores of those that
still can are completed from their own postings. Nothing is estimated: the k best of every task hold the k best of all.

The queries are a stated set against all rows. Their terms are broadcast in blocks of ``BLOCK_TERMS`` (query, term) rows, so a
larger set takes more blocks and no larger broadcast. Terms meet under 64-bit hashes.

Defined results: null texts and texts without a term belong to no document count and match nothing; a query without terms, or
of terms that no document holds, has no rows; rows of equal score are ranked by id, null ids last; rows of equal id are ranked
each; queries of equal id are ranked together as one query would be that holds the terms of all; an empty table on either side
gives an empty result; columns beyond id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.llm.packed import pack, spread, unpack
from millrace.session import arrow_map, materialise

TOP = 50
#: (query, term) rows that one block broadcasts.
BLOCK_TERMS = 1_000_000
#: Postings that a task orders and searches at a time.
INDEX_POSTINGS = 1_000_000


def _terms(batch_col: pa.Array):
    """(first row, rows, term hashes, offsets of the rows) by slices of bounded bytes."""
    for a, z, b, off in tv.chunks(batch_col):
        h, _, _, woff = tv.words(b, off, tv.ALNUM)
        yield a, z, h.view(np.int64), woff


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query, h``: distinct terms of each query."""
    base = queries.select(F.col(id_col).alias("query"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches):
        for batch in batches:
            for a, _, h, woff in _terms(batch.column(1)):
                row = np.repeat(np.arange(len(woff) - 1) + a, np.diff(woff))
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h)], names=["query", "h"])

    kind = base.schema["query"].dataType.simpleString()
    return materialise(arrow_map(base, run, f"query {kind}, h long").distinct(), "query-terms")[0]


def postings(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """A row for each slice of documents: ``n_docs, n_terms`` of all its documents; of those that hold a wanted term the
    ``ids``, their ``lengths``, the terms ``held`` (places in ``wanted``, in how many documents), and ``docs`` and counts."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # BLOCK_TERMS values at most
    names = ["n_docs", "n_terms", "ids", "lengths", "held", "docs"]

    def run(batches):
        wanted = shared.value
        for batch in batches:
            for a, z, h, woff in _terms(batch.column(1)):
                n = np.diff(woff)
                at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, np.int64)
                doc = np.searchsorted(woff, hit, "right") - 1
                some = np.unique(doc)
                key, tf = np.unique(at[hit] * max(1, len(some)) + np.searchsorted(some, doc), return_counts=True)
                term, held = np.unique(key // max(1, len(some)), return_counts=True)
                ids = batch.column(0).slice(a, z - a).take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids),
                        *(pa.array([pack(*x)], pa.binary()) for x in ((n[some],), (term, held), (key % max(1, len(some)), tf))),
                    ],
                    names=names,
                )

    kind = base.schema["id"].dataType.simpleString()
    schema = f"n_docs long, n_terms long, ids array<{kind}>, lengths binary, held binary, docs binary"
    return materialise(arrow_map(base, run, schema), "lexical-postings")[0]


def _frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each wanted term."""

    def run(batches):
        for batch in batches:
            found = [unpack(x) for x in batch.column(0).to_pylist()]
            if found:
                keys, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in arrow_map(index.select("held"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # n_terms rows at most
        out[r["term"]] = r["n"]
    return out


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whole-number impact of ``tf`` occurrences in documents of ``length`` terms."""
    if len(length) and int(length.max()) * 50 * n >= 1 << 63:  # beyond 64 bits: Python's whole numbers
        m = 50 + np.array([50 * int(x) * n // total for x in length], np.int64)
    else:
        m = 50 + 50 * length * n // max(1, total)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Index:
    """The postings of some slices by term and falling impact, and by document."""

    def __init__(self, slices: list[tuple[pa.Array, bytes, bytes, bytes]], w: np.ndarray, n: int, total: int):
        term, doc, tf, length, first = [], [], [], [], 0
        for ids, lengths, held, docs in slices:
            t, times = unpack(held)
            d, f = unpack(docs)
            term.append(np.repeat(t, times))
            doc.append(d + first)
            tf.append(f)
            length.append(unpack(lengths)[0])
            first += len(ids)
        self.ids = pa.concat_arrays([ids for ids, *_ in slices])
        term, doc, tf, length = (np.concatenate(x) for x in (term, doc, tf, length))
        gain = w[term] * impacts(tf, length[doc], n, total)
        order = np.lexsort((-gain, term))
        self.term, self.doc, self.gain = term[order], doc[order], gain[order]
        order = np.argsort(doc, kind="stable")
        self.own_term, self.own_gain = term[order], gain[order]
        self.own = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=first))])
        self.mine = np.zeros(len(w), bool)
        self.taken = 0  # postings that searches have read

    def search(self, terms: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) that hold the k best of this index among scores of at least ``least``, ties whole."""
        at, end = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        at, end = at[at < end], end[at < end]
        score = np.zeros(len(self.ids), np.int64)
        least = max(least, 1)
        while (left := at < end).any():
            heads = self.gain[at[left]]
            rest = int(heads.sum())  # no document gains more from here on
            if rest < least:  # documents not met so far are out: complete those that can still reach it
                some = np.flatnonzero((score > 0) & (score + rest >= least))
                if len(some) * len(terms) <= (end - at).sum():
                    return self._completed(some, terms, k, least)
            level = int(heads.max()) // 2
            for i in np.flatnonzero(left).tolist():
                z = at[i] + int(np.searchsorted(-self.gain[at[i] : end[i]], -level))  # the groups of impact above the level
                if z > at[i]:
                    score[self.doc[at[i] : z]] += self.gain[at[i] : z]
                    self.taken += int(z - at[i])
                    at[i] = z
            if np.count_nonzero(score) >= k:
                least = max(least, int(np.partition(score, -k)[-k]))
        some = np.flatnonzero(score >= least)
        return some, score[some]

    def _completed(self, some: np.ndarray, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(some):
            return some, some
        self.mine[terms] = True
        sizes = self.own[some + 1] - self.own[some]
        at = spread(self.own[some], sizes)
        gain = np.where(self.mine[self.own_term[at]], self.own_gain[at], 0)
        self.mine[terms] = False
        self.taken += len(at)
        score = np.add.reduceat(gain, np.cumsum(sizes) - sizes)
        if len(score) > k:
            least = max(least, int(np.partition(score, -k)[-k]))
        return some[score >= least], score[score >= least]


def _order(found: tuple[int, object]):
    score, own = found
    return -score, own is None, own


def _searched(index: DataFrame, queries: list[np.ndarray], w: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """``q, id, score``: the k best of each task for each query (a place in ``queries``)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast((queries, w))  # a block

    def run(batches):
        queries, w = shared.value
        best: list[list] = [[] for _ in queries]
        id_kind = None

        def search(slices):
            at = Index(slices, w, n, total)
            for q, terms in enumerate(queries):
                least = best[q][-1][0] if len(best[q]) == k else 0
                some, score = at.search(terms, k, least)
                if len(some):
                    best[q] = sorted([*best[q], *zip(score.tolist(), at.ids.take(pa.array(some)).to_pylist(), strict=True)], key=_order)[:k]

        held, size = [], 0
        for batch in batches:
            id_kind = batch.column(0).type.value_type
            for ids, *packed in zip(*batch.columns, strict=True):
                held.append((ids.values, *(x.as_py() for x in packed)))
                size += unpack(held[-1][2])[1].sum()
                if size >= INDEX_POSTINGS:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        rows = [(q, own, score) for q, found in enumerate(best) for score, own in found]
        if rows:
            q, ids, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, id_kind), pa.array(score, pa.int64())], names=["q", "id", "score"])

    return arrow_map(index.select("ids", "lengths", "held", "docs"), run, f"q long, id {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """``<query>, rank, <id>, score``: the k best documents of score above 0 of every query."""
    asked = query_terms(queries, query_col, query_text)
    blocks = 1 + asked.count() // BLOCK_TERMS
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).groupBy("query").agg(F.collect_list("h").alias("h")).collect()  # about BLOCK_TERMS values
        wanted = np.unique(np.array([h for r in own for h in r["h"]], np.int64))
        index = postings(docs, wanted, id_col, text_col)
        size = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
        terms = [np.searchsorted(wanted, np.sort(np.array(r["h"], np.int64))) for r in own]
        hits = _searched(index, terms, weights(size["n"], _frequencies(index, len(wanted))), size["n"], size["total"], k)
        names = docs.sparkSession.createDataFrame([(i, r["query"]) for i, r in enumerate(own)], f"q long, query {asked.schema['query'].dataType.simpleString()}")
        hits = hits.join(F.broadcast(names), "q").select("query", "id", "score")  # a row for each query of the block
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), "score")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_SQL_TERMS} AS term FROM benchmark)),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
o AS (SELECT r, doc_id, {_SQL_TERMS} AS term FROM d),
s AS (SELECT r, doc_id, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM s),
p AS (SELECT r, term, count(*) AS tf FROM o SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
g AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // total)))) AS gain
      FROM p JOIN s USING (r) JOIN w USING (term), c),
t AS (SELECT item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN g USING (term) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM t JOIN s USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
