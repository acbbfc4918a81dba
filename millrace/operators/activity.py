"""Activity logs: rate limits, quotas, spans, summaries."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.operators.fold import fold
from millrace.session import materialise


def _timed(requests: DataFrame, user: str, ts: str) -> DataFrame:
    return requests.select(F.col(user).alias("who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))


def admit_rate(requests: DataFrame, user: str, ts: str, most: int, window_seconds: float) -> DataFrame:
    """Sliding-window limiter: a request passes while fewer than ``most`` *admitted* ones are younger than the window;
    refused ones are not remembered. An ordered fold per user that keeps the last ``most`` admitted times; a request
    without a time is refused."""
    width = int(window_seconds * 1_000_000)

    def fresh():
        last = deque()

        def step(t):
            while t is not None and last and t - last[0] >= width:
                last.popleft()
            ok = t is not None and len(last) < most
            if ok:
                last.append(t)
            return (ok,)

        return step

    out = fold(_timed(requests, user, ts), ["who"], ["at"], ["at"], fresh, "admitted boolean")
    return out.select(F.col("who").alias(user), F.timestamp_micros("at").alias(ts), "admitted")


def admit_cooldown(requests: DataFrame, user: str, ts: str, cooldown: int = 60, cap: int = 2) -> DataFrame:
    """A request passes if the user's last admitted one is ``cooldown`` whole seconds away and fewer than ``cap`` were
    admitted in all; ``reason`` is ``cooldown``, ``cap``, ``time`` (a request without one) or null."""

    def fresh():
        last, n = 0, 0

        def step(t):
            nonlocal last, n
            if t is None:
                return ("time",)
            if n and int(cooldown - (t - last) / 1_000_000) > 0:
                return ("cooldown",)
            if n >= cap:
                return ("cap",)
            last, n = t, n + 1
            return (None,)

        return step

    out = fold(_timed(requests, user, ts), ["who"], ["at"], ["at"], fresh, "reason string")
    return out.select(F.col("who").alias(user), F.timestamp_micros("at").alias(ts), "reason")


def daily_quota(requests: DataFrame, user: str, ts: str, most: int = 10) -> DataFrame:
    """``requests`` with ``admitted``: the first ``most`` of a user's day; a user of very many requests is scanned."""
    dated = requests.withColumn("__day", F.to_date(ts)).withColumn("__one", F.lit(1))
    counted = scan.running(dated, [user, "__day"], [ts], "__one", "__n", "count")
    return counted.withColumn("admitted", F.col("__n") <= most).drop("__day", "__one", "__n")


def span_pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``span_id, started, ended, duration_ms``; a span without end keeps nulls."""
    s = starts.select("span_id", F.col("ts").alias("started"))
    e = ends.select("span_id", F.col("ts").alias("ended"))
    ms = F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000.0, 2)
    return s.join(e, "span_id", "left").withColumn("duration_ms", ms)


def trace_rollup(spans: DataFrame) -> DataFrame:
    """``trace_id, started, ended, duration (of the span that ends last), status``; error if any span failed."""
    return spans.groupBy("trace_id").agg(
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.max_by("duration", F.struct("ended", "span_id")).alias("duration"),
        F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"),
    )


def span_tree(spans: DataFrame) -> DataFrame:
    """``span_id, parent_id, root_id, level``: a missing parent makes a root. Span ids are unique.

    Pointer doubling: every span first points to its parent, then to what that points to, so a tree of any depth takes the
    logarithm of its depth in joins, each written out. Spans on or below a cycle have no root and are left out.
    """
    ids = spans.select(F.col("span_id").alias("p"))
    s = spans.select("span_id", "parent_id").join(ids, F.col("parent_id") == F.col("p"), "left").select("span_id", F.col("p").alias("parent_id"))
    level = F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long")
    now, _ = materialise(s.select("*", F.coalesce("parent_id", "span_id").alias("root_id"), level.alias("level"), F.lit(True).alias("open")), "tree")
    for _ in range(now.count().bit_length() + 1):
        up = now.select(F.col("span_id").alias("at"), F.col("root_id").alias("above"), F.col("level").alias("more"))
        on = now.join(up, F.col("root_id") == F.col("at"))
        now, _ = materialise(on.select("span_id", "parent_id", F.col("above").alias("root_id"), (F.col("level") + F.col("more")).alias("level"), (F.col("more") > 0).alias("open")), "tree")
        if now.filter("open").isEmpty():
            break
    return now.filter("NOT open").select("span_id", "parent_id", "root_id", F.col("level").cast("int").alias("level"))
