"""Toxicity by maximum-scoring segment search.

Learning, over a bounded sample of the labelled rows (``LABELLED_ROWS`` at most, smallest hash of id first: small enough
to be broadcast, so texts are never shuffled): document frequencies of tokens in both classes are aggregated (map-side combined, one row per token)
and turned into log-odds with an informative Dirichlet prior (the pooled counts are the prior). Tokens whose z-score
and log-odds exceed ``Z_MIN`` and ``W_MIN`` carry their log-odds; every other token costs ``DRIFT``, so a random text drifts downwards.

Scoring, over every whole text: a linear-time scan finds all maximal scoring segments (each is a maximal-sum passage
that no other contains). A segment of score S in a text of n tokens has the extreme-value p-value
``1 - exp(-exp(-(S - mu(n)) / beta))``; location and scale are fitted to the best segments of the non-toxic labelled
rows, with the location growing as log n. Segments with p below ``P_SEGMENT`` are the significant passages, and the
text's score is the calibrated probability from the sum of their -log p.

The lexicon is a model: it holds every significant token of the bounded labelled rows, so its size follows from theirs.
Calibration uses about ``CALIBRATION_ROWS`` rows of each class.

Defined results: null and empty texts have no tokens, no passage and the base score; equal texts score alike; with no
labelled rows, or one class only, every text has the base rate's side: score 0 (no toxic label) or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.session import arrow_map

#: A token needs this z-score and these log-odds to carry weight: words of a language or topic stay below.
Z_MIN, W_MIN = 4.5, 2.0
DRIFT = -0.25
#: Strength of the Dirichlet prior as a share of the smaller class.
PRIOR_SHARE = 0.1
LABELLED_ROWS = 50_000
CALIBRATION_ROWS = 6000
P_SEGMENT = 0.05


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes
    weights: np.ndarray
    beta: float = 1.0
    mu0: float = 0.0
    mu1: float = 0.0
    slope: float = 1.0
    cut: float = 0.0


def token_counts(rows: DataFrame, text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``h, n1, n0``: texts labelled 1 and 0 that hold each token hash.

    Counted per Arrow batch in numpy first, so what is shuffled is one row per token and batch.
    """

    def count(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            parts = []
            for a, z, b, off in tv.chunks(batch.column(0)):
                h, _, _, woff = tv.words(b, off, tv.ALNUM)
                for i in range(z - a):  # a token counts once per text, so bursts in one text weigh nothing
                    own = np.unique(h[woff[i] : woff[i + 1]])
                    parts.append((own, np.full(len(own), label[a + i])))
            if not parts:
                continue
            h, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at = np.unique(h, return_inverse=True)
            n1 = np.bincount(at, y == 1, len(keys)).astype(np.int64)
            n0 = np.bincount(at, y == 0, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n1), pa.array(n0)], names=["h", "n1", "n0"])

    some = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"))
    parts = arrow_map(some, count, "h long, n1 long, n0 long")
    return parts.groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def log_odds(counts: DataFrame) -> DataFrame:
    """``h, w, z``: log-odds with the pooled counts as Dirichlet prior, and its z-score."""
    totals = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    c = counts.join(F.broadcast(totals))  # totals: one row
    weight = PRIOR_SHARE * F.least("t1", "t0")
    prior = weight * (F.col("n1") + F.col("n0")) / (F.col("t1") + F.col("t0"))
    a1, a0 = F.col("n1") + prior, F.col("n0") + prior
    w = F.log(a1 / (F.col("t1") + weight - a1)) - F.log(a0 / (F.col("t0") + weight - a0))
    return c.select("h", w.alias("w"), (w / F.sqrt(1 / a1 + 1 / a0)).alias("z"))


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a token weight sequence, in linear time.

    Only positive runs can begin or end a segment, so the stack works on them; sums come from one cumulative sum.
    """
    pos = weights > 0
    if not pos.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(weights)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], pos.view(np.int8), [0]])))
    stack: list[list] = []  # start, end, left sum, right sum, index of the nearest earlier entry with a smaller left sum
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        new = [s, e, float(total[s]), float(total[e]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            new[4] = j
            if j < 0 or stack[j][3] >= new[3]:
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append(new)
    return [(s, e, right - left) for s, e, left, right, _ in stack]


def _token_weights(m: Model, h: np.ndarray) -> np.ndarray:
    if not len(m.keys):
        return np.full(len(h), DRIFT)
    at = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
    return np.where(m.keys[at] == h, m.weights[at], DRIFT)


def _scan(m: Model, col: pa.Array):
    """(row, words' starts, ends, segments) of every row."""
    for a, z, b, off in tv.chunks(col):
        h, starts, ends, woff = tv.words(b, off, tv.ALNUM)
        w = _token_weights(m, h)
        for i in range(z - a):
            lo, hi = woff[i], woff[i + 1]
            yield a + i, hi - lo, b, off[i], starts[lo:hi], ends[lo:hi], segments(w[lo:hi])


def _neg_log_p(m: Model, score: float, n: int) -> float:
    x = np.exp(-(score - m.mu0 - m.mu1 * np.log(max(n, 1))) / m.beta)
    return float(-np.log(max(-np.expm1(-x), 1e-300)))


def evidence(m: Model, n: int, segs: list[tuple[int, int, float]]) -> float:
    """Sum of -log p over the significant segments; the best one's alone if none is significant."""
    each = [_neg_log_p(m, s, n) for *_, s in segs]
    strong = [v for v in each if v > -np.log(P_SEGMENT)]
    return sum(strong) if strong else 0.1 * max(each, default=0.0)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``text, toxic`` of at most LABELLED_ROWS labelled rows (by id) that ``usable`` admits; a repeated label counts
    as 1 if any of its rows is. Only the sample of labels is broadcast: ids and labels of a bounded number of rows."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    marks = marks.orderBy(F.xxhash64(id_col), id_col).limit(LABELLED_ROWS)
    return docs.select(id_col, text_col).join(F.broadcast(marks), id_col).select(text_col, label_col)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from ``rows`` (text, 0/1 label), whose number the caller bounds."""
    rows = rows.filter(F.col(label_col).isin(0, 1))
    strong = log_odds(token_counts(rows, text_col, label_col)).filter((F.col("z") > Z_MIN) & (F.col("w") > W_MIN))
    lex = strong.select("h", "w").toPandas()  # significant tokens of LABELLED_ROWS texts
    order = np.argsort(lex.h.to_numpy(np.int64).view(np.uint64))
    m = Model(lex.h.to_numpy(np.int64).view(np.uint64)[order], lex.w.to_numpy(float)[order])
    scored = _best(rows, m, text_col, label_col)
    return _calibrate(m, scored)


def _best(rows: DataFrame, m: Model, text_col: str, label_col: str) -> pd.DataFrame:
    """Segment scores of about CALIBRATION_ROWS rows of each class (those with a small hash of text)."""
    some = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"))
    shared = rows.sparkSession.sparkContext.broadcast(m)  # significant tokens of LABELLED_ROWS texts

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            out = [{"n": int(n), "scores": [s for *_, s in segs], "y": y[i]} for i, n, *_, segs in _scan(shared.value, batch.column(0))]
            kind = pa.schema([("n", pa.int64()), ("scores", pa.list_(pa.float64())), ("y", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    key = F.pmod(F.xxhash64("t"), F.lit(1 << 40))
    sizes = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    below = F.lit(0)
    for y, n in sizes.items():
        below = F.when(F.col("y") == y, int((1 << 40) * min(1.0, CALIBRATION_ROWS / n))).otherwise(below)
    return arrow_map(some.filter(key < below), run, "n long, scores array<double>, y int").toPandas()


def _calibrate(m: Model, rows: pd.DataFrame) -> Model:
    """Gumbel location and scale from the non-toxic best segments, then a logistic map of the evidence."""
    clean = rows[rows.y == 0] if len(rows) else rows
    best = np.array([max(s, default=0.0) if len(s) else 0.0 for s in clean.scores], float)
    size = np.log(np.maximum(clean.n.to_numpy(float), 1)) if len(clean) else np.zeros(0)
    if len(best) >= 2:
        if size.std() > 1e-9:
            m.mu1 = max(0.0, float(np.cov(size, best)[0, 1] / size.var(ddof=1)))
        rest = best - m.mu1 * size
        m.beta = max(float(np.std(rest)) * np.sqrt(6) / np.pi, 0.2)
        m.mu0 = float(rest.mean()) - 0.5772156649 * m.beta
    if not len(rows) or rows.y.nunique() < 2:
        m.slope, m.cut = 1.0, 0.0 if len(rows) and rows.y.iloc[0] == 1 else 50.0
        return m
    x = np.array([evidence(m, n, [(0, 0, v) for v in s]) for n, s in zip(rows.n, rows.scores, strict=True)])
    y = rows.y.to_numpy()
    # The cut with the best balanced accuracy; in a gap between the classes, its middle.
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    gain = np.cumsum(np.where(ys == 0, 1 / max(1, (y == 0).sum()), -1 / max(1, (y == 1).sum())))
    ok = np.append(xs[1:] > xs[:-1], True)
    at = int(np.argmax(np.where(ok, gain, -9)))
    m.cut = float((xs[at] + xs[at + 1]) / 2) if at + 1 < len(xs) else float(xs[at]) + 1.0
    m.slope = 4.0 / max(m.cut, 0.5)
    return m


def score_texts(docs: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score, predicted, passages``: passages are significant segments, as
    ``array<struct<start,end,score,p>>`` with code-point offsets into the text (end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    clash = [c for c in ("score", "predicted", "passages") if c in docs.columns]
    base = docs.drop(*clash)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    piece = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            score, passages = np.zeros(len(batch)), []
            for i, n, b, at, starts, ends, segs in _scan(m, batch.column(batch.schema.get_field_index(text_col))):
                score[i] = 1 / (1 + np.exp(-np.clip(m.slope * (evidence(m, n, segs) - m.cut), -500, 500)))
                found = []
                for s, e, v in segs:
                    nlp = _neg_log_p(m, v, n)
                    if nlp > -np.log(P_SEGMENT):
                        chars = [int(np.count_nonzero((b[at : x] & 0xC0) != 0x80)) for x in (starts[s], ends[e - 1])]
                        found.append({"start": chars[0], "end": chars[1], "score": v, "p": float(np.exp(-nlp))})
                passages.append(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(passages, pa.list_(piece))],
                names=[*batch.schema.names, "score", "predicted", "passages"],
            )

    return arrow_map(base, run, f"{cols}, score double, predicted int, passages array<struct<start:long,end:long,score:double,p:double>>")


def held_out(key: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(mod)) == rest, F.lit(False))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = held_out(F.col("doc_id"), 5, 0)
    model = fit(labelled(docs, labels, ~held))
    out = score_texts(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
