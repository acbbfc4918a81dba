"""Date and time expressions. Every function that needs "now" takes it as ``anchor``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (month, day) of market holidays.
MARKET_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (12, 25))


def years_until(day: Column, anchor: Column) -> Column:
    return F.greatest(F.datediff(day, anchor) / 365.25, F.lit(0.0))


def days_until(epoch: Column, anchor: Column) -> Column:
    """Whole days, rounded down (also below zero)."""
    return F.floor((epoch - anchor) / 86400)


def epoch_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_year(c: Column) -> Column:
    """``Jan 2024`` to ``2024-01``, ``2024`` unchanged, other text unchanged, empty to null."""
    month = F.date_format(F.try_to_timestamp(F.concat(F.lit("1 "), c), F.lit("d MMM yyyy")), "yyyy-MM")
    year = F.when(c.rlike(r"^\d{4}$"), c)
    return F.when(F.length(c) > 0, F.coalesce(month, year, c))


def clock_seconds(c: Column) -> Column:
    """``HH:MM:SS.mmm`` or ``MM:SS.mmm`` in seconds."""
    p = F.split(c, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(p) == 2, part(0) * 60 + part(1))


def is_trading_day(day: Column) -> Column:
    holiday = F.array(*[F.lit(m * 100 + d) for m, d in MARKET_HOLIDAYS])
    return (F.weekday(day) < 5) & ~F.array_contains(holiday, F.month(day) * 100 + F.dayofmonth(day))


def market_open(ts: Column) -> Column:
    """Whether the market trades at a moment: a trading day, from 09:30 and before 16:00."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return is_trading_day(F.to_date(ts)) & (minute >= 570) & (minute < 960)


def epoch_iso(epoch: Column) -> Column:
    """Epoch seconds as ISO text in UTC; the session's zone is UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def next_on_weekday(day: Column, weekday: int) -> Column:
    """First date from ``day`` on (itself counts) with that weekday, Monday = 0."""
    return F.date_add(day, F.pmod(F.lit(weekday) - F.weekday(day), F.lit(7)).cast("int"))


def trading_days_between(start: Column, end: Column) -> Column:
    """Rough count: five sevenths of the days, cut."""
    return (F.datediff(end, start) * 5 / 7).cast("int")


def duration_ms(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000.0, 2)


STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%y": "yy", "%p": "a", "%I": "hh"}


def strftime(ts: Column, pattern: str) -> Column:
    """Formatting with the usual percent codes; other text is taken literally."""
    out, literal, i = "", "", 0
    while i <= len(pattern):
        code = pattern[i : i + 2]
        if code in STRFTIME or i == len(pattern):
            if literal:
                out += "'" + literal.replace("'", "''") + "'"
                literal = ""
            out += STRFTIME.get(code, "")
            i += 2
        else:
            literal += pattern[i]
            i += 1
    return F.date_format(ts, out)
