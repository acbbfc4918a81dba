"""Prefix scans: running sums, counts and last values along an order, where one key may hold most of the rows.

A window puts all rows of a key in one task. Here rows are dealt by ranges of (key, order), so a key may span any number of tasks.
Every task runs along its own rows; what a key brings to the next task is known from one row a task, its last key and that
key's value, and is added by a broadcast of these carries: as many rows as there are tasks.

Both forms give the same values. Keys below ``HOT_ROWS`` rows fit a task, so a window serves them with one shuffle; the scan
takes the keys beyond. Rows are counted by ``SLOTS`` hash slots of the key, added up before the shuffle: a slot holds whole keys,
so where no slot has so many rows no key has, and else only the keys of the full slots are counted.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import arrow_map, materialise

HOT_ROWS = 2_000_000
SLOTS = 1 << 14
KINDS = {"sum": "double", "count": "long"}


def hot_keys(df: DataFrame, by: list[str], least: int | None = None) -> DataFrame | None:
    """The keys of more than ``least`` rows; None if there are none."""
    least = HOT_ROWS if least is None else least
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS))
    full = [r["s"] for r in df.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).collect()]  # SLOTS rows at most
    if not full:
        return None
    return df.filter(slot.isin(full)).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least).select(*by)


def running(df: DataFrame, by: list[str], order: list[str], value: str, name: str, how: str = "sum", hot_rows: int | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum or count of ``value``, or the last of its values that isn't null, over the key's rows up to
    each row. Rows of equal order come in any order. Null is a key like any; null values add nothing. Keys of more than
    ``hot_rows`` rows are scanned."""
    if hot_rows == 0:
        return scanned(df, by, order, value, name, how, tasks)
    hot = hot_keys(df, by, hot_rows)
    if hot is None:
        return _windowed(df, by, order, value, name, how)
    hot, _ = materialise(hot, "hot-keys")
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(hot[c]) for c in by])
    rest = _windowed(df.join(hot, same, "left_anti"), by, order, value, name, how)
    return rest.unionByName(scanned(df.join(hot, same, "left_semi"), by, order, value, name, how, tasks))


def _windowed(df: DataFrame, by, order, value, name, how) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if how == "last":
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    if how == "count":
        return df.withColumn(name, F.count(value).over(w))
    return df.withColumn(name, F.coalesce(F.sum(F.col(value).cast("double")).over(w), F.lit(0.0)))


def _along(x: pa.Array, fresh: np.ndarray, how: str, carry):
    """Running values of one batch whose keys begin where ``fresh``; ``carry`` is the value before its first row."""
    n = len(x)
    first = np.flatnonzero(fresh)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(fresh, at, -1))  # first row of each row's key in this batch, -1: the key came before
    if how == "last":
        known = np.asarray(pc.is_valid(x))
        source = np.maximum.accumulate(np.where(known, at, -1))
        source = np.where(source >= start, source, -1)
        out = x.take(pa.array(np.where(source < 0, None, source).tolist(), pa.int64()))
        lead = (source < 0) & (start < 0)
        if carry is not None and carry.is_valid and lead.any():
            out = pc.if_else(pa.array(lead), carry, out)
        return out, out[n - 1]
    step = np.asarray(pc.is_valid(x)).astype(np.int64) if how == "count" else pc.fill_null(pc.cast(x, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    total = np.cumsum(step)
    before = np.where(start > 0, total[start - 1], 0) if len(first) else np.zeros(n, total.dtype)
    out = total - before + np.where(start < 0, carry or 0, 0)
    return pa.array(out, pa.int64() if how == "count" else pa.float64()), out[n - 1].item()


def scanned(df: DataFrame, by: list[str], order: list[str], value: str, name: str, how: str = "sum", tasks: int | None = None) -> DataFrame:
    """``running`` by ranges of (key, order), whatever the keys."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.drop(name)
    kind = KINDS.get(how) or base.schema[value].dataType.simpleString()
    dealt = base.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order).withColumn("__part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)

    def run(batches):
        last, carry, keys_met, rows = None, None, 0, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
            fresh = np.zeros(n, bool)
            for k in keys:
                fresh[1:] |= ~_equal(k.slice(1), k.slice(0, n - 1))
            head = [k[0].as_py() for k in keys]
            fresh[0] = last is None or head != last
            met = keys_met + np.cumsum(fresh)
            out, carry = _along(batch.column(batch.schema.get_field_index(value)), fresh, how, carry)
            yield pa.RecordBatch.from_arrays([*batch.columns, out, pa.array(met == 1), pa.array(np.arange(rows, rows + n))], names=[*batch.schema.names, name, "__leads", "__row"])
            last, keys_met, rows = [k[n - 1].as_py() for k in keys], int(met[-1]), rows + n

    local, _ = materialise(arrow_map(dealt, run, f"{fields}, `{name}` {kind}, __leads boolean, __row long"), "scan")
    return _carried(local, by, name, how)


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    same = pc.fill_null(pc.equal(a, b), False)
    return np.asarray(pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))))


def _carried(local: DataFrame, by: list[str], name: str, how: str) -> DataFrame:
    """Adds what a task's first key brings from the tasks before."""
    key = F.struct(*by)
    ends = local.groupBy("__part").agg(F.min_by(key, "__row").alias("first"), F.max_by(key, "__row").alias("last"), F.max_by(name, "__row").alias("value"))
    carries, carry, before = [], None, None
    for t in sorted(ends.collect(), key=lambda t: t["__part"]):  # a row a task
        goes_on = before is not None and t["first"] == before
        if goes_on and carry is not None:
            carries.append((t["__part"], carry))
        whole = goes_on and t["last"] == before  # the task holds nothing but that key
        if how == "last":
            carry = carry if whole and t["value"] is None else t["value"]
        else:
            carry = t["value"] + (carry if whole else 0)
        before = t["last"]
    kind = local.schema[name].dataType.simpleString()
    more = F.broadcast(local.sparkSession.createDataFrame(carries, f"__part int, __carry {kind}"))  # a row a task at most
    if how == "last":
        value = F.coalesce(name, F.when(F.col("__leads"), F.col("__carry")))
    else:
        value = F.col(name) + F.coalesce(F.when(F.col("__leads"), F.col("__carry")), F.lit(0))
    return local.join(more, "__part", "left").withColumn(name, value.cast(kind)).drop("__part", "__carry", "__leads", "__row")
