"""Streams with state for every key: views whose changes alone are written, admission with expiry, and progress while a job runs."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_value() -> None:
    """Processors are first set up by a process beside the driver that lacks the session's files, so they travel by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in the store that list and map state need; the session's setting comes back."""
    held = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, held) if held else spark.conf.unset(_PROVIDER)


# --- a view of every key's last rows ----------------------------------------------------------------------------------


class _LastRows(StatefulProcessor):
    def __init__(self, schema: T.StructType, order: str, n: int):
        self.schema, self.order, self.n = schema, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        at = names.index(self.order)
        held = [tuple(r) for r in self.rows.get()]
        for pdf in rows:
            held = sorted([*held, *pdf[names].itertuples(index=False, name=None)], key=lambda r: r[at], reverse=True)[: self.n]
        held = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in held]
        self.rows.put(held)
        out = pd.DataFrame(held, columns=names)
        out["place"] = range(1, len(out) + 1)
        for i, k in enumerate(self.by):
            out[k] = key[i]
        yield out[[*self.by, *names, "place"]]


def last_rows(log: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """``<by>, <the other columns>, place``: whenever rows of a key come, its ``n`` rows of greatest ``order``. The state is n
    rows a key; keys without new rows give nothing."""
    rest = T.StructType([f for f in log.schema if f.name not in by])
    _by_value()
    processor = _LastRows(rest, order, n)
    processor.by = by
    schema = T.StructType([*(log.schema[c] for c in by), *rest, T.StructField("place", T.IntegerType())])
    return log.groupBy(*by).transformWithStateInPandas(processor, schema, "Update", "None")


def view_changes(log: DataFrame, path: str, by: list[str], order: str, n: int, checkpoint: str):
    """A writer that keeps the last ``n`` rows of every key as a log of changes: a micro-batch writes the rows of the keys it
    touched, under its number, so what it writes follows from its own keys and not from the view, and a repeated batch
    replaces itself. ``view`` reads it."""

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={i}")

    return last_rows(log, by, order, n).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def view(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Every key's rows as its last change left them."""
    changes = spark.read.parquet(path)
    last = changes.groupBy(*by).agg(F.max("batch").alias("batch"))
    return changes.join(last, [*by, "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, by: list[str], to: str) -> DataFrame:
    """The view as it is, written as batch -1 of a new log."""
    view(spark, path, by).write.parquet(f"{to}/batch=-1")
    return view(spark, to, by)


# --- admission ----------------------------------------------------------------------------------------------------------


class _Cooldown(StatefulProcessor):
    def __init__(self, cooldown: int, cap: int, session: int | None):
        self.cooldown, self.cap, self.session = cooldown, cap, session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, n long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, seen = (int(x) for x in self.state.get()) if self.state.exists() else (0, 0, 0)
        times = sorted(int(t) for pdf in rows for t in pdf["at"].dropna())
        out = []
        for t in times:
            if self.session and n and t - seen > self.session * 1_000_000:
                n = 0
            seen = t
            if n and int(self.cooldown - (t - last) / 1_000_000) > 0:
                out.append((key[0], t, "cooldown"))
            elif n >= self.cap:
                out.append((key[0], t, "cap"))
            else:
                last, n = t, n + 1
                out.append((key[0], t, None))
        self.state.update((last, n, seen))
        if self.session and times:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(seen // 1000 + self.session * 1000 + 1)
        yield pd.DataFrame(out, columns=["who", "at", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])


def cooled_down(requests: DataFrame, user: str, ts: str, cooldown: int = 60, cap: int = 2, session: int | None = None, late: str = "0 seconds") -> DataFrame:
    """``who, at (microseconds), reason``: a request of a stream passes if the user's last admitted one is ``cooldown`` whole
    seconds away and fewer than ``cap`` were admitted, in all or since the user was silent for ``session`` seconds. Requests
    of a user are taken in time order within each micro-batch. With ``session`` a timer frees the state of users who are gone."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.select(F.col(user).alias("who"), F.col(ts).cast("timestamp").alias("time"), at.alias("at"))
    rows = rows.withWatermark("time", late) if session else rows
    _by_value()
    schema = T.StructType([rows.schema["who"], T.StructField("at", T.LongType()), T.StructField("reason", T.StringType())])
    return rows.groupBy("who").transformWithStateInPandas(_Cooldown(cooldown, cap, session), schema, "Append", "EventTime" if session else "None")


# --- progress -------------------------------------------------------------------------------------------------------------


class Progress(StreamingQueryListener):
    """Collects, while a stream runs, how many rows are done of how many: a row for each micro-batch that had any, from the
    metrics observed in it under ``name``."""

    def __init__(self, name: str, total: int):
        self.name, self.total, self.done, self.rows, self.lock = name, total, 0, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and seen["rows"]:
            with self.lock:
                self.done += seen["rows"]
                self.rows.append((event.progress.batchId, self.done, self.total, round(100.0 * self.done / self.total, 1)))

    def onQueryTerminated(self, event) -> None:
        pass


def observed(rows: DataFrame, name: str) -> DataFrame:
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def run_with_progress(spark: SparkSession, writer, listener: Progress) -> DataFrame:
    """Runs a stream to the end of what is there; ``batch, done, total, percent`` as they were reported while it ran."""
    spark.streams.addListener(listener)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        wanted = query.lastProgress["batchId"] if query.lastProgress else -1
        deadline = threading.Event()
        for _ in range(100):  # reports come after the batch
            with listener.lock:
                if listener.done >= listener.total or (listener.rows and listener.rows[-1][0] >= wanted):
                    break
            deadline.wait(0.1)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame(listener.rows, "batch long, done long, total long, percent double")


def stages_done(rows: DataFrame, order: list[str]) -> DataFrame:
    """What ``Progress`` must report never to fall: whether ``done`` and ``percent`` grow and end at the total."""
    w = Window.orderBy(*order)  # a row for each micro-batch
    falls = F.count_if(F.col("before") > F.col("done"))
    return rows.withColumn("before", F.lag("done").over(w)).agg((falls == 0).alias("never_falls"), (F.max("done") == F.max("total")).alias("complete"), F.max("percent").alias("percent"))
