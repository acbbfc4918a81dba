"""The user-defined sources and sinks: resume, reconnect, commit and abort."""

import io
import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.sources import feeds


def _said(ids):
    return "".join(f"id: {i}\nevent: tick\ndata: line {i}\ndata: more\n\n: a comment\n\n" for i in ids)


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_feed_stops_and_resumes(spark, tmp_path):
    feeds.register(spark)
    _write(tmp_path / "feed", "000.txt", _said(range(10)))
    _write(tmp_path / "feed", "001.txt", _said(range(10, 15)) + "event: without data\n\n")

    def run():
        stream = spark.readStream.format("event_feed").option("path", str(tmp_path / "feed")).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(15))
    assert run() == list(range(15))
    _write(tmp_path / "feed", "002.txt", _said(range(15, 40)))
    assert run() == list(range(40))
    batch = spark.read.format("event_feed").option("path", str(tmp_path / "feed")).load()
    assert batch.rdd.getNumPartitions() == 3 and {(r.event, r.data) for r in batch.filter("id = 7").collect()} == {("tick", "line 7\nmore")}


def test_a_broken_connection_is_opened_again():
    text = _said(range(300)).encode()
    tries = []

    class Broken(io.BytesIO):
        def read(self, n=-1):
            if len(tries) < 3 and self.tell() > 1000 * len(tries):
                raise OSError("reset")
            return super().read(700)

    def opened(path, segment):
        tries.append(1)
        return Broken(text)

    assert [m[0] for m in feeds.messages("p", "s", wait=0, opened=opened)] == list(range(300)) and len(tries) > 1

    def never(path, segment):
        raise OSError("gone")

    with pytest.raises(OSError):
        list(feeds.messages("p", "s", wait=0, opened=never))


def test_insert_commit_abort_and_read_back(spark, tmp_path):
    feeds.register(spark)
    to = {"connection": str(tmp_path / "db"), "table": "held rows", "batch": "7"}
    rows = spark.range(100).select("id", F.concat(F.lit("o'name "), "id").alias("na me"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("v")).repartition(4)
    back = lambda: spark.read.format("dbapi").options(**to).schema(rows.schema).load()
    rows.write.format("dbapi").options(**to).mode("append").save()
    assert sorted(map(tuple, back().collect())) == sorted(map(tuple, rows.collect()))
    bad = rows.select("id", "na me", F.when(F.col("id") == 50, F.raise_error(F.lit("stop"))).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("dbapi").options(**to).mode("append").save()
    assert back().count() == 100
    rows.limit(30).write.format("dbapi").options(**to).mode("append").save()
    assert back().count() == 130
    rows.limit(5).write.format("dbapi").options(**to).mode("overwrite").save()
    assert back().count() == 5
    with sqlite3.connect(tmp_path / "db") as db:
        assert [r[0] for r in db.execute("SELECT name FROM sqlite_master")] == ["held rows"]
    rows.limit(0).write.format("dbapi").options(**to).mode("overwrite").save()
    assert back().count() == 0
