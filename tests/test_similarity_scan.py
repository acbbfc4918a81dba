"""Similarity joins and prefix scans against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import core, ledger, scan, similarity


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_set_join(spark, least):
    rng = random.Random(4)
    weights = [1 / (i + 1) for i in range(50)]
    sets = [sorted(set(rng.choices(range(50), weights, k=rng.choice([1, 2, 5, 12])))) for _ in range(150)]
    for s in sets[:60]:
        sets.append(sorted({*s[1:], rng.randrange(50)}))
    rows = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(sets)] + [(900, None), (901, [])], "id long, tokens array<string>")
    reps, members = similarity.classes(rows)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    assert {(r["id"], r["class"]) for r in members.collect()} == {(i, first[tuple(s)]) for i, s in enumerate(sets)}
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b, round(jac(set(x), set(y)), 9)) for x, a in first.items() for y, b in first.items() if a < b and jac(set(x), set(y)) >= least - 1e-9}
    assert {(r.a, r.b, round(r.jaccard, 9)) for r in similarity.set_join(reps, None, least).collect()} == want
    other = reps.filter("id % 3 = 0")
    want = {(a, b) for x, a in first.items() for y, b in first.items() if b % 3 == 0 and jac(set(x), set(y)) >= least - 1e-9}
    assert {(r.a, r.b) for r in similarity.set_join(reps, other, least).collect()} == want
    assert similarity.set_join(reps.limit(0), None, least).count() == 0


def test_set_join_has_no_product(spark):
    """Frequent tokens do not pair all sets: what meets stays near what is similar."""
    rows = spark.createDataFrame([(i, [f"w{j}" for j in range(10)] + [f"own{i}x{j}" for j in range(10)]) for i in range(600)], "id long, tokens array<string>")
    plan = similarity.set_join(rows, None, 0.8)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    met = similarity._prefixes(rows, counts, 0.8)
    assert met.join(met.select("token", F.col("id").alias("b")), "token").count() == met.count()


@pytest.mark.parametrize("least", [50, 70, 80, 90, 100])
def test_edit_pairs(spark, least):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    names = sorted({word(rng.randrange(0, 14)) for _ in range(150)})
    asked = sorted({n[:i] + rng.choice(["", "x", "ab"]) + n[i + rng.randrange(2) :] for n in names for i in [rng.randrange(len(n) + 1)]})
    got = {(r.x, r.y, round(r.score, 6)) for r in similarity.edit_pairs(spark.createDataFrame([(x,) for x in asked], "x string"), spark.createDataFrame([(y,) for y in names], "y string"), least).collect()}
    score = lambda x, y: 100.0 if not (x or y) else 100 * (1 - lev(x, y) / max(len(x), len(y)))
    assert got == {(x, y, round(s, 6)) for x in asked for y in names if (s := score(x, y)) >= least}


def test_auto_correct(spark):
    names = spark.createDataFrame([("Blue Steel Bolt",), ("blue steel belt",), ("Red Gear",), ("Cold Nut",), ("cold nat",), (None,)], "name string")
    asked = spark.createDataFrame([("steel blue bolt",), ("red gaer",), ("cold nyt",), ("none such",), (None,)], "asked string")
    got = {r.asked: (r.corrected, r.suggestions) for r in similarity.auto_correct(similarity.fuzzy_match(asked, names, "asked", "name", 70), "asked", "name").collect()}
    assert got["steel blue bolt"][0] == "Blue Steel Bolt" and got["red gaer"] == ("Red Gear", "Red Gear")
    assert got["cold nyt"] == (None, "Cold Nut, cold nat") and "none such" not in got


def _skewed(spark, n=4000, share=0.9):
    rng = random.Random(6)
    rows = [(None if (k := rng.random()) > 0.98 else "hot" if k < share else f"k{rng.randrange(30)}", i // 2, i, rng.choice([None, float(rng.randrange(9)), 1.5])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, i long, v double")


@pytest.mark.parametrize("how", ["sum", "count", "last"])
def test_scan_equals_window(spark, how, monkeypatch):
    df = _skewed(spark)
    want = sorted(map(str, scan._windowed(df, ["k"], ["t", "i"], "v", "out", how).collect()))
    for tasks in (1, 3, 8, 40):
        assert sorted(map(str, scan.scanned(df, ["k"], ["t", "i"], "v", "out", how, tasks).select("k", "t", "i", "v", "out").collect())) == want
    assert sorted(map(str, scan.running(df, ["k"], ["t", "i"], "v", "out", how, hot_rows=500).select("k", "t", "i", "v", "out").collect())) == want
    assert scan.scanned(df.limit(0), ["k"], ["t", "i"], "v", "out", how).count() == 0


def test_scan_in_small_batches_and_by_two_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = _skewed(spark, 600).withColumn("k2", F.col("i") % 2)
        for how in ("sum", "count", "last"):
            want = sorted(map(str, scan._windowed(df, ["k", "k2"], ["t", "i"], "v", "out", how).collect()))
            assert sorted(map(str, scan.scanned(df, ["k", "k2"], ["t", "i"], "v", "out", how, 5).select(*df.columns, "out").collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_key_is_spread_evenly(spark, monkeypatch):
    """One key with 90 % of the rows: no task holds more than twice the median."""
    seen, held = {}, scan.materialise

    def noted(df, name):
        out = held(df, name)
        seen[name] = out[0]
        return out

    monkeypatch.setattr(scan, "materialise", noted)
    scan.scanned(_skewed(spark, 20_000), ["k"], ["t", "i"], "v", "out", "sum", 8).count()
    sizes = sorted(r["count"] for r in seen["scan"].groupBy("__part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_hot_keys_of_joins_and_positions(spark):
    left = spark.createDataFrame([("a", t) for t in range(0, 300, 3)] + [("b", 5), (None, 7)], "k string, t long")
    right = spark.createDataFrame([("a", t, float(t)) for t in range(10, 300, 7)] + [("b", 6, 1.0)], "k string, t long, v double")
    got = [sorted(map(str, core.as_of(left, right, "k", "t", "t", "v", hot).collect())) for hot in (None, 0, 20)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 102
    trades = spark.createDataFrame([("x", "s", i, float((-1) ** i * i)) for i in range(200)], "account string, symbol string, ts long, signed double")
    assert sorted(map(str, ledger.running_position(trades, ["ts"], 0).collect())) == sorted(map(str, ledger.running_position(trades, ["ts"]).collect()))
