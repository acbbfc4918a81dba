"""Keyed state over several micro-batches equals the batch form; progress ends at 100 % and never falls."""

import os
import random

from pyspark.sql import functions as F

from millrace.operators import activity, core
from millrace.streaming import keyed


def _feed(spark, rows, folder, parts, schema=None):
    """A file stream that gives ``rows`` in ``parts`` micro-batches, in their order."""
    whole = rows.schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(whole).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def _bytes(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_view_writes_its_changes_only(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"k{rng.randrange(400)}", i, f"text {i}") for i in range(6000)], "k string, n long, v string")
    parts = [rows.filter((F.col("n") >= a) & (F.col("n") < a + 1900)) for a in (0, 1900, 3800)] + [rows.filter("n >= 5700 AND k = 'k1' OR n = 5999"), rows.filter("n >= 5700 AND k <> 'k1' AND n < 5999")]
    log = _feed(spark, rows, tmp_path, parts)
    with keyed.state_store(spark):
        q = keyed.view_changes(log, f"{tmp_path}/out", ["k"], "n", 5, f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    want = core.first_n(rows, ["k"], [F.desc("n")], 5, "place")
    got = keyed.view(spark, f"{tmp_path}/out", ["k"])
    key = lambda df: sorted(tuple(r) for r in df.select("k", "n", "v", "place").collect())
    assert key(got) == key(want)
    sizes = [_bytes(f"{tmp_path}/out/batch={i}") for i in range(5)]
    assert sizes[3] < 0.2 * sizes[2]  # two keys, whatever the view holds
    assert key(keyed.compact(spark, f"{tmp_path}/out", ["k"], f"{tmp_path}/compacted")) == key(want)


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(12)}", t) for t in sorted(rng.randrange(4000) for _ in range(500))]
    df = spark.createDataFrame(rows, "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    cuts = [0, 900, 1800, 4001]
    parts = [df.filter((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < z)) for a, z in zip(cuts, cuts[1:], strict=False)]
    log = _feed(spark, df, tmp_path, parts)
    with keyed.state_store(spark):
        q = keyed.cooled_down(log, "u", "ts", 60, 9).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select("who", F.timestamp_micros("at").alias("ts"), "reason").collect()))
    want = activity.admit_cooldown(df, "u", "ts", 60, 9).select(F.col("u").alias("who"), "ts", "reason")
    assert got == sorted(map(str, want.collect())) and len(got) == 500


def test_sessions_of_a_user_end(spark, tmp_path):
    times = [t + 100_000 for t in (0, 70, 140, 1000, 1070, 1140, 5000)]
    df = spark.createDataFrame([("u", t) for t in times], "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    parts = [df.filter(F.unix_seconds("ts").isin(times[a:z])) for a, z in ((0, 2), (2, 5), (5, 7))]
    with keyed.state_store(spark):
        log = _feed(spark, df, tmp_path, parts)
        q = keyed.cooled_down(log, "u", "ts", 60, 2, session=600).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    got = {r.at // 1_000_000 - 100_000: r.reason for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: None, 70: None, 140: "cap", 1000: None, 1070: None, 1140: "cap", 5000: None}


def test_progress_while_it_runs(spark, tmp_path):
    rows = spark.range(1000)
    log = _feed(spark, rows, tmp_path, [rows.filter(f"id % 4 = {i}") for i in range(4)])
    writer = keyed.observed(log, "done").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out")
    out = keyed.run_with_progress(spark, writer, keyed.Progress("done", 1000)).orderBy("batch").collect()
    assert [(r.done, r.percent) for r in out] == [(250, 25.0), (500, 50.0), (750, 75.0), (1000, 100.0)]
    assert keyed.stages_done(spark.createDataFrame(out), ["batch"]).first()[:3] == (True, True, 100.0)
