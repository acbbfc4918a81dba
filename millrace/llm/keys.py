"""Keys of texts, values computed once, and dropping rows that take no part in a join before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_POWER = 24


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a text (null: empty); equal texts share verdicts, whatever their ids."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("text"), t).alias("k2")


def once(value: Column) -> Column:
    """An expensive value that is filtered on and used again, computed once a row: the condition always holds, but the
    optimizer takes it for one that depends on the task, so it neither copies the expression nor moves it."""
    return F.when(F.spark_partition_id() >= 0, value)


def _bitmap(wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Presence of keys by hash, as rows of 4 KB: 2 ** FILTER_POWER bits whatever their number."""
    slot = F.shiftrightunsigned(F.xxhash64(F.col(wanted_key)), 64 - FILTER_POWER)
    rows = wanted.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("__bucket"))
    return rows.agg(F.expr("bitmap_construct_agg(s % 32768)").alias("__bits"))


def _flagged(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, how: str) -> DataFrame:
    """``df`` with ``__may``: whether its key may be among ``wanted``; the bitmap is broadcast."""
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_POWER)
    at = df.withColumn("__s", slot).withColumn("__bucket", F.expr("__s div 32768"))
    byte = F.expr("cast(conv(hex(substring(__bits, cast((__s % 32768) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.shiftright(byte.bitwiseAND(F.expr("shiftleft(1, cast(__s % 8 as int))")), 0) != 0
    met = at.join(F.broadcast(_bitmap(wanted, wanted_key)), "__bucket", how)
    return met.withColumn("__may", F.coalesce(hit, F.lit(False))).drop("__s", "__bucket", "__bits")


def only_keys(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be among ``wanted``: rows that take no part are dropped before any shuffle. False positives pass;
    nothing that is wanted is lost."""
    return _flagged(df, key, wanted, wanted_key, "inner").filter("__may").drop("__may")


def without(df: DataFrame, on: list[str], gone: DataFrame) -> DataFrame:
    """Rows whose key ``on`` is not in ``gone`` (an anti join). Only rows that may be there are shuffled; the others, of a corpus
    that keeps most of itself nearly all, stay where they are."""
    marked = _flagged(df, F.col(on[0]), gone, on[0], "left")
    rest = marked.filter("__may").drop("__may").join(gone, on, "left_anti").select(*df.columns)
    return marked.filter("NOT __may").select(*df.columns).unionByName(rest)
