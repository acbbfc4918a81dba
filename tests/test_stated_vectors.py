"""Stated query vectors against all: equal to brute force, and a task hands on no more than its best."""

import numpy as np

from millrace.operators import vectors


def _cosines(rows, k):
    vecs = {i: np.array(v, float) for i, v in rows if v is not None}
    size = lambda x: np.sqrt((x * x).sum()) or 1.0
    return {(q, i): float(vecs[q] @ v / size(vecs[q]) / size(v)) for q in vecs if q % k == 0 for i, v in vecs.items() if len(v) == len(vecs[q])}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 30)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(30)] + [(431, None), (432, [0.0] * 6), (440, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    score = _cosines(rows, 40)
    found = vectors.nearest(v, v.filter("id % 40 = 0"), 7)
    assert found.count() <= 12 * 7 * 5 * 2  # at most k a query and task; it was a row for each of the 4,700 pairs
    best = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], -round(r["score"], 8), r["id"])):
        best.setdefault(r["query_id"], []).append(r["id"])
    for q in {q for q, _ in score}:
        want = sorted((i for p, i in score if p == q), key=lambda i: (-round(score[q, i], 8), i))[:7]
        assert best[q][:7] == want
    got = {(r["query_id"], r["id"]) for r in vectors.above(v, v.filter("id % 40 = 0"), 0.3).filter("score >= 0.3").collect()}
    assert got == {p for p, s in score.items() if s >= 0.3}
    assert vectors.nearest(v.limit(0), v.limit(0), 3).count() == 0
