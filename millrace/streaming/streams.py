"""Structured Streaming forms: file sources, event-time windows, paired spans, stateful admission, change logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.numbers import LIMITS, severity
from millrace.session import ship


def source(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None, fmt: str = "json") -> DataFrame:
    """New files of a folder as a stream; the schema is fixed and progress lives in the query's checkpoint, so a broken
    reader resumes where it stopped."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.format(fmt).load(folder)


def append(events: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    return events.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint).start(path)


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """``start, end, <by>, n, total`` per window; also works on a batch. ``late`` sets the watermark."""
    return windowed(events, ts, by, late, F.window(ts, width))


def sliding(events: DataFrame, ts: str, width: str, slide: str, by: list[str], late: str | None = None) -> DataFrame:
    return windowed(events, ts, by, late, F.window(ts, width, slide))


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    return windowed(events, ts, by, late, F.session_window(ts, gap))


def windowed(events: DataFrame, ts: str, by: list[str], late: str | None, window) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    out = e.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def alerts(metrics: DataFrame) -> DataFrame:
    """Stateless monitor: ``kind, value`` readings above their limits, with a severity."""
    level = F.lit(None).cast("string")
    for kind in LIMITS:
        level = F.when(F.col("kind") == kind, severity(F.col("value"), kind)).otherwise(level)
    return metrics.withColumn("severity", level).filter("severity IS NOT NULL")


def paired(starts: DataFrame, ends: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Stream-stream join of span starts and ends by ``span_id``; state is dropped once a pair can no longer come."""
    s = starts.select("span_id", F.col("ts").alias("started")).withWatermark("started", late)
    e = ends.select(F.col("span_id").alias("end_id"), F.col("ts").alias("ended")).withWatermark("ended", late)
    on = F.expr(f"span_id = end_id AND ended >= started AND ended <= started + INTERVAL {longest}")
    ms = F.round((F.unix_micros("ended") - F.unix_micros("started")) / 1000.0, 2)
    return s.join(e, on).select("span_id", "started", "ended", ms.alias("duration_ms"))


def unique(events: DataFrame, ts: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """First event of every key within the watermark: a content cache by hash, or exactly-once intake."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def _limit(key, batches: Iterator[pd.DataFrame], state: GroupState, most: int, width: int) -> Iterator[pd.DataFrame]:
    last = list(state.get[0]) if state.exists else []
    for pdf in batches:
        out = []
        for t in sorted(pdf.ts):
            now = t.value // 1000
            last = [x for x in last if now - x < width]
            ok = len(last) < most
            if ok:
                last.append(now)
            out.append((key[0], t, ok))
        yield pd.DataFrame(out, columns=["user", "ts", "admitted"])
    state.update((last,))


def rate_limited(requests: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """Sliding-window limiter over ``user, ts``: the state is the user's admitted times within the window, at most
    ``most`` of them. Requests of a user are taken in time order within each micro-batch."""
    width = int(window_seconds * 1_000_000)
    ship(requests.sparkSession)
    kind = requests.schema["user"].dataType.simpleString()
    return requests.select("user", "ts").groupBy("user").applyInPandasWithState(
        lambda k, b, s: _limit(k, b, s, most, width), f"user {kind}, ts timestamp, admitted boolean", "last array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def server_events(messages: DataFrame, text: str = "text") -> DataFrame:
    """``event, id, data`` of every message of a server-sent-event text (batch or stream): messages end at a blank line, data
    lines of one message are joined by line feeds, and a message without data is none. The other columns stay."""
    rest = [c for c in messages.columns if c != text]
    blocks = messages.select(*rest, F.explode(F.split(F.col(text), r"\r?\n[ \t]*\r?\n")).alias("__b"))
    lines = F.split("__b", r"\r?\n")
    field = lambda name: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", "")), "\n")
    out = blocks.select(*rest, *[F.nullif(field(c), F.lit("")).alias(c) for c in ("event", "id", "data")])
    return out.filter("data IS NOT NULL")


def live_view(log: DataFrame, path: str, by: list[str], order: list, n: int, checkpoint: str):
    """A stream's last ``n`` rows per key, kept current: every micro-batch writes the next version ``<path>/v<batch>`` from the
    one before and its own rows, so a repeated batch gives the same version and each holds n rows a key."""
    from millrace.operators.core import first_n

    def keep(batch: DataFrame, i: int) -> None:
        rows = batch if i == 0 else batch.unionByName(batch.sparkSession.read.parquet(f"{path}/v{i - 1}"))
        first_n(rows, by, order, n).drop("rank").write.mode("overwrite").parquet(f"{path}/v{i}")

    return log.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def ticks(spark: SparkSession, start: str, end: str, minutes: int, always: bool = False) -> DataFrame:
    """``tick``: when a job that runs every so many minutes runs, on open markets only unless ``always``."""
    from millrace.functions.dates import market_open

    bound = lambda s: F.lit(s).cast("timestamp_ntz")
    out = spark.range(1).select(F.explode(F.sequence(bound(start), bound(end), F.expr(f"INTERVAL {minutes} MINUTES"))).alias("tick"))
    return out if always else out.filter(market_open(F.col("tick")))


def completion_order(tasks: DataFrame, group: str, done, task: str) -> DataFrame:
    """``place`` of every task in the order in which its group's tasks end; ties go by task id."""
    return tasks.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(done, task)))


def progress(tasks: DataFrame, group: str, order: list) -> DataFrame:
    """``done, total, percent`` of the group as each task ends."""
    w = Window.partitionBy(group)
    out = tasks.withColumn("done", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    return out.withColumn("percent", F.round(100.0 * F.col("done") / F.col("total"), 1))


def latest_state(log: DataFrame, thread: str, version: str) -> DataFrame:
    """Append-only state table: the newest row of every thread (batch)."""
    return log.groupBy(thread).agg(F.max_by(F.struct(*log.columns), version).alias("s")).select("s.*")


def state_at(log: DataFrame, thread: str, version: str, at) -> DataFrame:
    """Time travel: the newest row of every thread at or before version ``at`` (batch)."""
    return latest_state(log.filter(F.col(version) <= at), thread, version)


def replay(df: DataFrame, schedule: DataFrame, day: str = "day") -> DataFrame:
    """Rows labelled with their step of a virtual clock: the number of scheduled days up to theirs."""
    from millrace.sources.tables import with_row_index

    return df.join(with_row_index(schedule.select(day).distinct(), day, name="step"), day)
