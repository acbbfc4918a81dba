"""Two-phase aggregates: equal to brute force, and the memory of a task does not follow the size of a group."""

import random
import tracemalloc

from pyspark.sql import functions as F

from millrace.operators import aggregate, core


def _rows(n=3000):
    rng = random.Random(8)
    return [(None if rng.random() < 0.02 else rng.choice("aaaaaab"), rng.randrange(500), rng.choice([None, "x", "y", "z", "w"])) for _ in range(n)]


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        own = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
        got = {r.k: r.kinds for r in aggregate.aggregate(df, ["k"], ["o", "v"], aggregate.ordered_unique()).collect()}
        first = {k: {v: min(o for _, o, w in g if w == v) for v in {x[2] for x in g} - {None}} for k, g in own.items()}
        assert got == {k: ",".join(sorted(f, key=lambda v: (f[v], v))) for k, f in first.items()}
        named = df.filter("v IS NOT NULL")
        got = {r.k: (r.body, r.item_count) for r in aggregate.aggregate(named, ["k"], ["o", "v"], aggregate.first_n(7)).collect()}
        for k, g in own.items():
            kept = sorted((o, v) for _, o, v in g if v is not None)
            assert [x for x, _ in kept[:7]] and got[k][1] == len(kept)
            low = [o for o, _ in kept[:7]]
            assert len(got[k][0].split()) == 7 and all(v in {w for o, w in kept if o <= low[-1]} for v in got[k][0].split())
        got = {r.k: (r.n, r.last_role) for r in aggregate.aggregate(df, ["k"], ["o", "v"], aggregate.last_message()).collect()}
        assert got == {k: (len(g), max((o, v or "") for _, o, v in g)[1] or None) for k, g in own.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert aggregate.aggregate(df.limit(0), ["k"], ["o", "v"], aggregate.first_n(3)).count() == 0


def test_state_does_not_grow_with_the_group():
    how = aggregate.first_n(20)

    def peak(n):
        tracemalloc.start()
        state = how.start()
        for i in range(n):
            state = how.add(state, (i * 7919) % 100_003, i, f"text {i}")
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, how.result(state)

    (small, _), (large, result) = peak(2_000), peak(20_000)
    assert large < 2 * small and result[1] == 20_000


def test_interval_counts_and_nodes(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([0, 1, 7, 4000, 10**9, -1])) for a in (rng.randrange(-3000, 3000) for _ in range(200))] + [(None, 3), (-(2**40), 2**40)]
    points = sorted({rng.randrange(-4000, 9000) for _ in range(200)})
    s, p = spark.createDataFrame(spans, "lo long, hi long"), spark.createDataFrame([(x,) for x in points], "x long")
    got = {r.x: r.n for r in core.interval_counts(p, s, "x", "lo", "hi", "n").collect()}
    real = [(a, b) for a, b in spans if a is not None]
    assert got == {x: sum(a <= x <= b for a, b in real) for x in points}
    held = s.select("lo", "hi", core.dyadic_cover(F.col("lo"), F.col("hi")).alias("c")).filter("hi >= lo").collect()
    assert all(len(r.c) <= 2 * max(1, (r.hi - r.lo + 1).bit_length()) for r in held)
    pairs = {(r.x, r.lo, r.hi) for r in core.interval_join(p, s, "x", "lo", "hi").collect()}
    assert pairs == {(x, a, b) for x in points for a, b in real if a <= x <= b}
    assert core.interval_join(p.limit(0), s, "x", "lo", "hi").count() == 0 and core.interval_counts(p, s.limit(0), "x", "lo", "hi", "n").agg(F.sum("n")).first()[0] == 0
