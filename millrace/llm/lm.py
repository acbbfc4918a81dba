"""Language-model scoring: log probability of every whole text under a gated recurrent network learnt from the corpus.

Tokens are words (runs of bytes other than ASCII white space, A-Z lower-cased) and one end for each document. Counts of all
training documents give the base score. The ``VOCABULARY`` most frequent tokens, the end and one token for the rest are what
the network predicts; a word of the rest has the probability of that token times its own share of the rest, by the smoothed
counts. So the score is a log probability over all tokens, like the base.

Counting: every task pre-aggregates its words, one shuffle adds them up. Training: all training documents (``TRAIN_SHARE`` is 1;
callers may pass less), dealt by a hash of their text over ``ROUNDS`` rounds: every task starts from the round's parameters (a model of fixed size) and runs truncated
backpropagation over its documents, and the changes are averaged by tokens, slice by slice, on the executors.
Scoring: one pass over all texts with the state carried over windows to each document's end; it also writes, for slices of
documents, postings of the words outside the vocabulary. These words, each rarer than any of the vocabulary, are too many to
broadcast: their counts and postings meet in a cogroup by word hash, counts first, and what they add is summed by document.

Words meet under 64-bit hashes. Defined results: null and empty texts are the end alone; rows of null id train and are scored;
rows are documents, so repeated ids and texts count each; without training documents the counts are 0, the base is 0 for the
end alone of an empty vocabulary and the network predicts by a count of one for each of its two tokens; an empty table gives
an empty result; columns beyond id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import recurrent as rn
from millrace.llm import textvec as tv
from millrace.llm.packed import pack, unpack
from millrace.llm.toxicity import held_out
from millrace.session import arrow_map, materialise

#: Tokens that the network predicts, the end and the rest among them, and its classes.
VOCABULARY, CLASSES = 2048, 24
TRAIN_SHARE, ROUNDS = 1.0, 2
#: Words whose counts a task of the cogroup holds at most, about; slices that the parameters are averaged in.
BUCKET_WORDS, MODEL_SLICES = 500_000, 64
#: Distinct words that a task adds up before it hands them on.
COUNTED = 400_000
#: Buckets are dealt over several slots beyond these bytes of postings.
SLOT_BYTES = 64 << 20


@dataclass
class Words:
    """What all training documents hold: tokens, distinct tokens, documents, and the vocabulary with its counts."""

    total: int
    distinct: int
    docs: int
    keys: np.ndarray  # sorted hashes of the vocabulary's words
    number: np.ndarray  # their token numbers
    counts: np.ndarray  # by token number, in falling order
    rest: int  # number of the token for other words
    end: int
    tail_total: int  # occurrences of words outside, and how many these are
    tail_distinct: int

    def mass(self) -> np.ndarray:
        """Smoothed counts by token number: the base's half a count for each word, those outside and one unseen included."""
        out = self.counts + 0.5
        out[self.rest] += 0.5 * self.tail_distinct
        return out

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), self.rest)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.number[at], self.rest)


def word_counts(texts: DataFrame) -> DataFrame:
    """``h, n`` of every word of the column ``t``."""

    def run(batches):
        held, size = [], 0

        def added():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def rows(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for _, _, b, off in tv.chunks(batch.column(0)):
                held.append(np.unique(tv.words(b, off)[0], return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    held = [added()]
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*added())

    return arrow_map(texts, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, docs: int, most: int = VOCABULARY) -> Words:
    """The most frequent words and the sums of all, from ``h, n``."""
    size = F.floor(F.log2("n") * 8).alias("size")
    steps = counts.groupBy(size).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()  # 8 rows for each power of 2
    steps.sort(key=lambda r: -r["size"])
    total, distinct = sum(r["n"] for r in steps), sum(r["words"] for r in steps)
    seen, least = 0, 0
    for r in steps:
        seen += r["words"]
        if seen >= most - 2:
            least = r["size"]
            break
    # Words of the size at which the vocabulary ends and above: no more of them move than these.
    top = counts.filter(F.floor(F.log2("n") * 8) >= least).orderBy(F.desc("n"), "h").limit(most - 2).collect()
    h, n = (np.array([r[c] for r in top], np.int64) for c in ("h", "n"))
    every = np.concatenate([n, [total - n.sum(), docs]])
    order = np.argsort(-every, kind="stable")
    number = np.empty(len(every), np.int64)
    number[order] = np.arange(len(every))
    keys = h.view(np.uint64)
    by_key = np.argsort(keys)
    return Words(
        total + docs, distinct + (docs > 0), docs, keys[by_key], number[: len(h)][by_key], every[order], int(number[len(h)]), int(number[len(h) + 1]),
        int(total - n.sum()), int(distinct - len(h)),
    )


def _laid(batch_col: pa.Array, words: Words):
    """(first row, rows, hashes, token numbers, offsets of the rows) of slices of some MB."""
    for a, z, b, off in tv.chunks(batch_col):
        h, _, _, woff = tv.words(b, off)
        yield a, z, h, words.numbers(h), woff


def train(texts: DataFrame, words: Words, share: float = TRAIN_SHARE, rounds: int = ROUNDS) -> rn.Network:
    """The network after ``rounds`` rounds over ``share`` of ``t`` (each round takes its own documents)."""
    net = rn.fresh(words.mass(), CLASSES)
    sc = texts.sparkSession.sparkContext
    place = F.pmod(F.xxhash64(F.lit("train"), "t"), F.lit(1 << 40)) / float(1 << 40)
    for r in range(rounds):
        own = texts.filter((place >= share * r / rounds) & (place < share * (r + 1) / rounds))
        start = net.flat()
        shared = sc.broadcast((net, words))  # a model of fixed size

        def run(batches, shared=shared):
            net, words = shared.value
            net.square, start, n = {}, net.flat(), 0
            for batch in batches:
                tokens, off = [], [np.zeros(1, np.int64)]
                for _, _, _, number, woff in _laid(batch.column(0), words):
                    tokens.append(number)
                    off.append(off[-1][-1] + woff[1:])
                if tokens:
                    n += rn.train(net, np.concatenate(tokens), np.concatenate(off), words.end)[1]
            if n:
                change = np.array_split((net.flat() - start) * np.float32(n), MODEL_SLICES)
                net.load(start)  # the worker may run another task with this broadcast
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(MODEL_SLICES), pa.int32()), pa.array([n] * MODEL_SLICES, pa.int64()), pa.array([c.tobytes() for c in change], pa.binary())],
                    names=["part", "n", "change"],
                )

        def add(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for part, n, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = sums.setdefault(part, [0, 0.0])
                    own[0] += n
                    own[1] = own[1] + np.frombuffer(change, np.float32).astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([c.tobytes() for _, c in sums.values()], pa.binary())],
                    names=["part", "n", "change"],
                )

        schema = "part int, n long, change binary"
        parts = arrow_map(own, run, schema).repartition("part").sortWithinPartitions("part", "n")
        done = sorted(arrow_map(parts, add, schema).collect())  # MODEL_SLICES rows, one model in all
        if done:
            net.load(start + np.concatenate([np.frombuffer(p["change"], np.float64) / p["n"] for p in done]).astype(np.float32))
            net.square = {}
    return net


def _scored(docs: DataFrame, words: Words, net: rn.Network, buckets: int, id_col: str, text_col: str, held: Column) -> DataFrame:
    """The written pass: a row for each document (``row, id, held, n_tokens, known, rest, base, model``) and, for slices of
    documents, a row for each bucket of word hashes (``row`` of the first document, ``bucket, found, docs``)."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    shared = docs.sparkSession.sparkContext.broadcast((words, net))  # fixed size
    names = ["row", "id", "held", "n_tokens", "known", "rest", "base", "model", "bucket", "found", "docs"]

    def run(batches):
        words, net = shared.value
        below = words.total + 0.5 * (words.distinct + 1)
        log_base = np.log10((words.counts + 0.5) / below)
        log_base[words.rest] = 0.0  # added by the cogroup
        known = np.arange(len(words.counts)) != words.rest
        known[words.end] = words.docs > 0
        for batch in batches:
            rows, tokens, offs, parts = batch.column(0).to_numpy(), [], [np.zeros(1, np.int64)], []
            for a, z, h, number, woff in _laid(batch.column(3), words):
                tokens.append(number)
                offs.append(offs[-1][-1] + woff[1:])
                other = np.flatnonzero(number == words.rest)
                doc = np.searchsorted(woff, other, "right") - 1
                parts += [(rows[a], *p) for p in _postings(h[other], doc, z - a, buckets)]
            if not tokens:
                continue
            number, off = np.concatenate(tokens), np.concatenate(offs)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
            n = len(rows)
            columns = [
                batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(off) + 1), pa.array(sums(known[number].astype(np.int64)) + int(known[words.end])),
                pa.array(sums((number == words.rest).astype(np.int64))), pa.array(sums(log_base[number]) + log_base[words.end]),
                pa.array(rn.score(net, number, off, words.end) / np.log(10)),
            ]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            if parts:
                m = len(parts)
                columns = [pa.array([p[0] for p in parts], pa.int64()), *(pa.nulls(m, c.type) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([p[i] for p in parts], k) for i, k in ((1, pa.int32()), (2, pa.binary()), (3, pa.binary())))], names=names)

    kind = base.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held boolean, n_tokens long, known long, rest long, base double, model double, bucket int, found binary, docs binary"
    return materialise(arrow_map(base, run, schema), "lm-scores")[0]


def _postings(h: np.ndarray, doc: np.ndarray, n_docs: int, buckets: int):
    """(bucket, words with the number of their documents, documents with occurrences) of one slice, by bucket."""
    if not len(h):
        return
    words, at = np.unique(h, return_inverse=True)
    key, times = np.unique(at * n_docs + doc, return_counts=True)
    word, doc = key // n_docs, key % n_docs
    bucket = (tv.mix(words) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket[word], kind="stable")
    word, doc, times = word[order], doc[order], times[order]
    edges = np.searchsorted(bucket[word], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        a, z = edges[k], edges[k + 1]
        own, held = np.unique(word[a:z], return_counts=True)
        yield k, pack(np.diff(words[own], prepend=np.uint64(0)), held), pack(doc[a:z], times[a:z])


def rest_sums(scored: DataFrame, counts: DataFrame, words: Words, buckets: int) -> DataFrame:
    """``row, known, logs``: occurrences of counted words outside the vocabulary in each document, and the sum over all such
    words of log10(c + 0.5): the cogroup of postings and counts by word hash."""
    vocabulary = words.keys
    shared = counts.sparkSession.sparkContext.broadcast(vocabulary)  # VOCABULARY hashes

    def dealt(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            inside = np.isin(h, shared.value)
            bucket = (tv.mix(h) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "h", "n"]).filter(pa.array(~inside))

    sizes = scored.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum(F.length("docs") + F.length("found")).alias("n"))
    slots = sizes.select("bucket", (1 + F.expr(f"n div {SLOT_BYTES}")).alias("slots"))
    first = arrow_map(counts.select("h", "n"), dealt, "bucket int, h long, n long")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = first.join(F.broadcast(slots), "bucket").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))  # slots: a row a bucket
    first = first.select("bucket", "slot", F.lit(0).alias("kind"), F.col("h").alias("key"), "n", nothing("binary", "found"), nothing("binary", "docs"))
    then = scored.filter("bucket IS NOT NULL").select("bucket", "row", "found", "docs").join(F.broadcast(slots), "bucket")
    then = then.select("bucket", F.pmod(F.xxhash64("row"), F.col("slots")).alias("slot"), F.lit(1).alias("kind"), F.col("row").alias("key"), nothing("long", "n"), "found", "docs")
    stream = first.unionByName(then).repartition("bucket", "slot").sortWithinPartitions("bucket", "slot", "kind", "key")

    def run(batches):
        at, parts, table = None, [], None
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)])
            kinds = batch.column(2).to_numpy()
            if not len(kinds):
                continue
            edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), len(kinds)]
            out = []
            for a, z in zip(edges, edges[1:], strict=False):
                if at != tuple(names[:, a]):
                    at, parts, table = tuple(names[:, a]), [], None
                mid = a + int(np.searchsorted(kinds[a:z], 1))
                if mid > a:
                    parts.append([batch.column(i).slice(a, mid - a).to_numpy(zero_copy_only=False) for i in (3, 4)])
                for i in range(mid, z):
                    if table is None:
                        table = _table(parts)
                    out.append(_added(table, batch.column(3)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["row", "known", "logs"])

    sums = arrow_map(stream, run, "row long, known long, logs double")
    return sums.groupBy("row").agg(F.sum("known").alias("more"), F.sum("logs").alias("logs"))


def _table(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a bucket in order, with their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order].astype(float)


def _added(table, first: int, found: bytes, docs: bytes):
    """(row, occurrences of counted words, sum of logs) that one slice's postings of one bucket add."""
    keys, n = table
    step, held = unpack(found)
    h = np.cumsum(step.view(np.uint64))
    count = np.zeros(len(h))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        count = np.where(keys[at] == h, n[at], 0.0)
    doc, times = unpack(docs)
    c = np.repeat(count, held)
    some, at = np.unique(doc, return_inverse=True)
    known = np.bincount(at, np.where(c > 0, times, 0), len(some)).astype(np.int64)
    return first + some, known, np.bincount(at, times * np.log10(c + 0.5), len(some))


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", share: float = TRAIN_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: ``<id>, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).
    ``trains`` says which rows are learnt from."""
    texts = docs.filter(trains).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counts, _ = materialise(word_counts(texts), "words")
    words = vocabulary(counts, texts.count())
    net = train(texts, words, share, rounds)
    buckets = 32 + words.tail_distinct // BUCKET_WORDS
    scored = _scored(docs, words, net, buckets, id_col, text_col, ~trains)
    out = scored.filter("bucket IS NULL").join(rest_sums(scored, counts, words, buckets), "row", "left")
    logs, rest = F.coalesce("logs", F.lit(0.0)), F.col("rest")
    base = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    tail = float(np.log10(words.tail_total + 0.5 * (words.tail_distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + logs - rest * base).alias("base_score"),
        (F.col("model") + logs - rest * tail).alias("score"),
    )


def op11(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), ~held_out(F.col("doc_id"), 5, 1))
