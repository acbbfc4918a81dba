"""Approximate nearest neighbours over learned partitions.

On a bounded sample (``SAMPLE`` vectors, smallest hash first) the exact neighbour graph is cut into balanced parts by
recursive bisection: a smooth vector over the graph (power iteration) is split at its median and the halves are
refined by balanced swaps. A small network (one hidden layer) learns to tell a vector's part. It then sends *every* row
to its most probable part, and every query to its several most probable parts; the candidates found there are reranked
by exact cosine in double precision. How many parts a query visits is set on ``HELD`` sample vectors that the network was
not trained on: the fewest whose recall against brute force, less two standard errors, reaches ``TARGET_RECALL``. On
vectors without any structure that is most of the parts.

A part is cut into blocks of ``BLOCK_VALUES`` numbers at most. A task holds one block and lets the part's queries stream
past it, so a vector travels once and a query once for each block that it visits; only where a block would meet more than
``PAIRS`` (query, vector) pairs are its queries dealt to several tasks, each with the block. Parts are ranked for queries
only, and the model (a few matrices) is all that is broadcast.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have not the commonest length
take no part, neither do rows with a null id; a query's own row is every row with its id; fewer than ``k`` candidates
in the visited parts send the query to all parts, so all candidates are returned if there are fewer than k; equal
scores are ordered by id. Repeated rows (same id) are candidates once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.session import arrow_map, materialise

SAMPLE, GRAPH_K, HIDDEN = 5000, 10, 96
PARTS, MAX_PARTS, PART_ROWS = 64, 256, 65_536
TARGET_RECALL = 0.93
HELD = 1000
BLOCK_VALUES, PAIRS = 1 << 22, 1 << 31


@dataclass
class Model:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    sample_recall: float = 1.0

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _neighbours(x: np.ndarray, k: int, block: int = 1000) -> np.ndarray:
    out = []
    for s in range(0, len(x), block):
        sim = x[s : s + block] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out.append(np.argpartition(-sim, min(k, len(x) - 1) - 1, 1)[:, :k])
    return np.concatenate(out)


def _bisect(nb: np.ndarray, members: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size that cut few edges of the neighbour graph."""
    place = np.full(len(nb), -1)
    place[members] = np.arange(len(members))
    edges = place[nb[members]]
    row = np.repeat(np.arange(len(members)), edges.shape[1])[edges.ravel() >= 0]
    col = edges.ravel()[edges.ravel() >= 0]
    i, j = np.concatenate([row, col]), np.concatenate([col, row])
    degree = np.maximum(np.bincount(i, minlength=len(members)), 1)
    v = rng.normal(size=len(members))
    for _ in range(40):  # smooth, and keep clear of the constant vector
        v = 0.5 * v + 0.5 * np.bincount(i, v[j], len(members)) / degree
        v -= np.average(v, weights=degree)
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(len(members), bool)
    side[np.argsort(v, kind="stable")[len(members) // 2 :]] = True
    for _ in range(6):  # swap equally many documents that have more neighbours across
        across = np.bincount(i, side[i] != side[j], len(members))
        gain = 2 * across - degree
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        move = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
        if not move:
            break
        side[left[:move]], side[right[:move]] = True, False
    return members[~side], members[side]


def partition(nb: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(nb))]
    while len(groups) < parts:
        groups = [h for g in groups for h in (_bisect(nb, g, rng) if len(g) > 1 else (g, g[:0]))]
    label = np.zeros(len(nb), int)
    for i, g in enumerate(groups):
        label[g] = i
    return label


def fit(x: np.ndarray, parts: int, k: int = 5, seed: int = 5, target: float = TARGET_RECALL) -> Model:
    """Learn parts and classifier from sample vectors (rows of ``x``, any norm)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    near = _neighbours(x, GRAPH_K)
    label = partition(near, parts, seed)
    order = rng.permutation(len(x))
    held = order[: min(HELD, len(x) // 5)]  # not trained on: they set the number of probes
    learnt = np.setdiff1d(order, held)
    y = np.zeros((len(x), parts))
    np.add.at(y, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0)  # where its neighbours are
    y[np.arange(len(x)), label] += near.shape[1]
    y /= y.sum(1, keepdims=True)
    p = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * 0.1, np.zeros(parts)]
    m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(12):
        order = rng.permutation(learnt)
        for s in range(0, len(order), 128):
            b = order[s : s + 128]
            h = np.maximum(x[b] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - y[b]) / len(b)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for q, g in enumerate((x[b].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m1[q] = 0.9 * m1[q] + 0.1 * g
                m2[q] = 0.999 * m2[q] + 0.001 * g * g
                p[q] -= 3e-3 * (m1[q] / (1 - 0.9**t)) / (np.sqrt(m2[q] / (1 - 0.999**t)) + 1e-8)
    model = Model(*p)
    logits = model.logits(x)
    home = logits.argmax(1)
    rank = np.empty_like(logits, dtype=int)
    np.put_along_axis(rank, np.argsort(-logits, 1), np.arange(parts)[None, :], 1)
    tried = held if len(held) else learnt
    true = _neighbours(x, min(k, len(x) - 1))[tried]
    depth = np.take_along_axis(rank[tried], home[true], 1)  # at which probe each true neighbour turns up
    recall = [(depth < m).mean() for m in range(1, parts + 1)]
    sure = [r - 2 * np.sqrt(r * (1 - r) / max(1, depth.size)) for r in recall]
    model.probes = next((m for m, r in enumerate(sure, 1) if r >= target), parts)
    model.sample_recall = float(recall[model.probes - 1])
    return model


def usable(vec: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda c: c != 0), F.lit(False))


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def prepare(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(rows that take part as ``id, v``, their number, their length)."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return rows.limit(0), 0, 0
    rows = rows.filter(F.size("v") == lengths["d"]).groupBy("id").agg(F.min("v").alias("v"))
    return rows, lengths["n"], lengths["d"]


def search(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows by cosine of every row that ``queries`` (over ``id``) admits."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, n, dim = prepare(table, id_col, vec_col)
    if n < 2:
        return spark.createDataFrame([], schema)
    key = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    share = min(1.0, 2 * SAMPLE / n)
    some = rows.filter(key < int(share * (1 << 40))).orderBy(key, "id").limit(SAMPLE).toPandas()  # bounded sample
    sample = np.stack(some.v.to_numpy()).astype(np.float64)
    if len(sample) < 2:
        sample = np.stack(rows.limit(SAMPLE).toPandas().v.to_numpy()).astype(np.float64)
    wanted = parts or min(MAX_PARTS, max(PARTS, 1 << int(np.log2(max(1, n / PART_ROWS)))))
    model = fit(sample, min(wanted, 1 << int(np.log2(len(sample)))), k)
    shared = spark.sparkContext.broadcast(model)  # a few small matrices

    def assign(batches):
        m = shared.value
        for batch in batches:
            x = _vectors(batch.column(1))
            part = m.logits(x).argmax(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "v", "part"])

    def rank(batches):
        m = shared.value
        for batch in batches:
            x = _vectors(batch.column(1))
            order = np.argsort(-m.logits(x), 1, kind="stable").astype(np.int32) if len(x) else np.zeros((0, m.parts), np.int32)
            top = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.parts, pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, top], names=["id", "v", "parts"])

    placed, _ = materialise(arrow_map(rows, assign, "id long, v array<double>, part int"), "parts")
    asked, _ = materialise(arrow_map(placed.filter(queries).select("id", "v"), rank, "id long, v array<double>, parts array<int>"), "asked")
    block = max(256, BLOCK_VALUES // dim)
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_PARTS rows
    found = _rerank(placed, asked, F.slice("parts", 1, model.probes), sizes, block, k)
    # Too few candidates in the visited parts: such a query visits the others too.
    found, _ = materialise(found, "found")
    short = asked.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")), F.col("id") == F.col("query_id"), "left")
    short = short.filter(F.coalesce("c", F.lit(0)) < min(k, n - 1)).select("id", "v", "parts")
    if model.probes < model.parts and not short.isEmpty():
        more = _rerank(placed, short, F.col("parts"), sizes, block, k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")


def _rerank(placed: DataFrame, asked: DataFrame, visits: Column, sizes: dict, block: int, k: int) -> DataFrame:
    """The ``k`` nearest of the visited parts for each query."""
    asks = asked.select("id", "v", F.explode(visits).alias("part"))
    load = {r["part"]: r["n"] for r in asks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_PARTS rows
    both = sorted(set(sizes) & set(load))
    vb = {p: -(-sizes[p] // block) for p in both}
    qb = {p: -(-load[p] * min(sizes[p], block) // PAIRS) for p in both}
    as_map = lambda d: F.create_map(*[F.lit(x) for p in both for x in (p, d[p])])
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda d: d.withColumn("nv", as_map(vb)[F.col("part")]).withColumn("nq", as_map(qb)[F.col("part")]).filter("nv IS NOT NULL")
    schema = "query_id long, vec_id long, score double"
    if not both:
        return placed.sparkSession.createDataFrame([], f"{schema}, rank int")
    cols = ["part", "vb", "qb", "side", "id", "v"]
    rows = sized(placed.select("id", "v", "part")).withColumn("vb", pick("nv")).withColumn("qb", spread("nq")).withColumn("side", F.lit(0))
    asks = sized(asks).withColumn("qb", pick("nq")).withColumn("vb", spread("nv")).withColumn("side", F.lit(1))

    def run(batches):
        key, held, ready = None, [], None
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy() for i in range(3)])
            side, ids = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            x = _vectors(batch.column(5))
            change = (names[:, 1:] != names[:, :-1]).any(0) | (side[1:] != side[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            out = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if (own := tuple(names[:, s])) != key:
                    key, held, ready = own, [], None
                if side[s] == 0:
                    held.append((ids[s:e], x[s:e].copy()))
                elif held:
                    if ready is None:  # the block is complete once its first query comes
                        v = np.concatenate([h[1] for h in held])
                        ready = np.concatenate([h[0] for h in held]), v, np.sqrt((v * v).sum(1))
                        held = held[:1]
                    out += _nearest(*ready, ids[s:e], x[s:e], k)
            if out:
                a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    stream = rows.select(cols).unionByName(asks.select(cols)).repartition("part", "vb", "qb").sortWithinPartitions("part", "vb", "qb", "side")
    near = arrow_map(stream, run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(ids, x, norm, asked, q, k: int):
    """The k best of one block for each query; ties are settled on scores computed the same way for every pair."""
    out = []
    length = np.sqrt((q * q).sum(1))
    step = max(1, (1 << 21) // len(ids))
    for s in range(0, len(asked), step):
        sim = (q[s : s + step] @ x.T) / norm
        sim /= length[s : s + step, None]
        sim[asked[s : s + step, None] == ids[None, :]] = -np.inf
        floor = -np.partition(-sim, k - 1, 1)[:, k - 1] if sim.shape[1] > k else np.full(len(sim), -np.inf)
        for r in range(len(sim)):
            c = np.flatnonzero((sim[r] >= floor[r] - 1e-9) & np.isfinite(sim[r]))
            score = (x[c] * q[s + r]).sum(1) / (norm[c] * length[s + r])
            best = np.lexsort((ids[c], -score))[:k]
            out.append((np.full(len(best), asked[s + r]), ids[c[best]], score[best]))
    return out


def op4(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("id") % 50 == 0)
