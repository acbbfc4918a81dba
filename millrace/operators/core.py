"""Relational building blocks: latest-n, top-n, joins with defaults, ranks, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.session import materialise
from millrace.sources.tables import with_row_index

BROADCAST_BYTES = 64 << 20
#: Blocks that a query set beyond that size meets the rows in.
BLOCKS = 256


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is below BROADCAST_BYTES."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint where the size estimate allows it; otherwise left to AQE."""
    return F.broadcast(df) if is_small(df) else df


def with_each(rows: DataFrame, queries: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """All rows beside every row of a stated query set. A set too large to broadcast meets the rows in blocks: a row goes to
    one block, the queries to all of them."""
    if is_small(queries):
        return rows.crossJoin(F.broadcast(queries))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(blocks)))
    asked = queries.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.join(asked, "__block").drop("__block")


def where(df: DataFrame, **equal) -> DataFrame:
    """Optional equality filters: arguments that are None are left out."""
    return reduce(lambda d, kv: d if kv[1] is None else d.filter(F.col(kv[0]) == kv[1]), equal.items(), df)


def first_n(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def lookup(facts: DataFrame, dim: DataFrame, on: Column, value: str, default=0.0) -> DataFrame:
    """Left join with a default for what is missing."""
    return facts.join(small(dim), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def strict_lookup(facts: DataFrame, dim: DataFrame, on: Column, value: str) -> DataFrame:
    """Left join that fails on a missing value."""
    joined = facts.join(small(dim), on, "left")
    return joined.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit(f"no {value}"))).otherwise(F.col(value)))


def as_of(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, value: str, hot_rows: int | None = None) -> DataFrame:
    """For every left row the latest right value at or before its time.

    Both sides are merged into one stream per key and the last value is carried forward: no range join, and a key that holds
    most of the rows is scanned over many tasks. Right rows come first at equal times.
    """
    l = left.select("*", F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = right.select(F.col(by), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = scan.running(l.unionByName(r, allowMissingColumns=True), [by], ["__ts", "__side"], "__v", value, "last", hot_rows)
    return both.filter("__side = 1").drop("__ts", "__side", "__v")


#: Powers of two that a coordinate may span: beyond 2 ** DYADIC units from the origin nothing is held by one node.
DYADIC = 62


def dyadic_cover(low: Column, high: Column) -> Column:
    """The span [low, high] of whole numbers as nodes ``(level, node)`` of the binary tree over them: a node of level h holds
    2 ** h numbers from node * 2 ** h on. At most two nodes a level, so at most 2 log2 of the length + 2; none if high < low."""
    first = lambda h: F.shiftright(low + (F.lit(1).cast("long") * F.expr(f"shiftleft(1L, {h})")) - 1, h)
    last = lambda h: F.shiftright(high + 1, h) - 1
    node = lambda h, n: F.struct(F.lit(h).alias("level"), n.alias("node"))
    parts = []
    for h in range(DYADIC):
        # The nodes of a level that lie inside and whose parent does not: at the left end an odd one, at the right an even one.
        a, z = first(h), last(h)
        left = (a <= z) & (a % 2 != 0)
        right = (a <= z) & (z % 2 == 0) & ~(left & (a == z))
        parts += [F.when(left, node(h, a)), F.when(right, node(h, z))]
    return F.array_compact(F.array(*parts))


def dyadic_path(point: Column, levels: Column) -> Column:
    """The nodes ``(level, node)`` above a whole number, of the given ``levels``."""
    return F.transform(levels, lambda h: F.struct(h.alias("level"), F.call_function("shiftright", point, h).alias("node")))


def interval_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Points within [low, high], all whole numbers. A span is held by at most 2 log2 n + 2 nodes of a binary tree, however long,
    and a point asks the nodes above it, on the levels that any span uses: one equi-join, each pair met once."""
    s = spans.withColumn("__at", F.explode(dyadic_cover(F.col(low).cast("long"), F.col(high).cast("long"))))
    s, _ = materialise(s, "nodes")
    used = s.select(F.col("__at.level").alias("l")).distinct().agg(F.array_sort(F.collect_list("l")).alias("__levels"))  # DYADIC values at most
    p = points.crossJoin(F.broadcast(used)).withColumn("__at", F.explode(dyadic_path(F.col(point).cast("long"), F.col("__levels")))).drop("__levels")
    return p.join(s, "__at").drop("__at")


def interval_counts(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, name: str) -> DataFrame:
    """``points`` (distinct) with the number of spans that hold each: spans are added up by node before any point meets them."""
    nodes = spans.select(F.explode(dyadic_cover(F.col(low).cast("long"), F.col(high).cast("long"))).alias("__at"))
    nodes, _ = materialise(nodes.groupBy("__at").agg(F.count(F.lit(1)).alias("__n")), "nodes")
    used = nodes.select(F.col("__at.level").alias("l")).distinct().agg(F.array_sort(F.collect_list("l")).alias("__levels"))  # DYADIC values at most
    paths = points.crossJoin(F.broadcast(used)).select(*points.columns, F.explode_outer(dyadic_path(F.col(point).cast("long"), F.col("__levels"))).alias("__at"))
    return paths.join(nodes, "__at", "left").groupBy(*points.columns).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias(name))


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points within [low, high]: spans are exploded over the buckets they touch, so the join is an equi-join. For spans of
    few buckets; ``interval_join`` takes spans of any length."""
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(s, "__b").filter(F.col(point).between(F.col(low), F.col(high))).drop("__b")


def borda(ranked: DataFrame, item: str, position: str, judges: str) -> DataFrame:
    """``rank_sum, mean_rank (over all judges), mean_seen (over appearances), points (N - position)``."""
    n = ranked.select(F.countDistinct(judges).alias("__j"), F.countDistinct(item).alias("__n"))
    sums = ranked.groupBy(item).agg(F.sum(position).alias("rank_sum"), F.count(F.lit(1)).alias("seen"))
    out = sums.crossJoin(F.broadcast(n))  # one row
    return out.select(
        item, "rank_sum", (F.col("rank_sum") / F.col("__j")).alias("mean_rank"), (F.col("rank_sum") / F.col("seen")).alias("mean_seen"),
        (F.col("seen") * (F.col("__n") + 1) - F.col("rank_sum")).alias("points"),
    )


def batches(df: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    """Groups of ``size`` consecutive rows within a key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


# --- data audit -----------------------------------------------------------------------------------------------------


def missing(df: DataFrame) -> DataFrame:
    """``column, missing``: nulls of all columns in one pass."""
    counted = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(counted, df.columns, "missing")


def distinct(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, n_distinct``: distinct non-null values; sketches where ``approximate``. Exact counts shuffle a column at a
    time, each distinct value of a task once."""
    if approximate:
        return _long(df.select(*[F.approx_count_distinct(c).alias(c) for c in df.columns]), df.columns, "n_distinct")
    one = lambda c: df.select(F.col(c).alias("v")).filter("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    return reduce(DataFrame.unionByName, [one(c).select(F.lit(c).alias("column"), "n_distinct") for c in df.columns])


def _long(one_row: DataFrame, columns, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias(value)) for c in columns])
    return one_row.select(F.inline(pairs))


def duplicates(df: DataFrame) -> DataFrame:
    """``duplicates``: rows beyond the first of equal rows."""
    return df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("duplicates"))


def leakage_candidates(columns: list[str], target: str | None = None) -> list[str]:
    low = (target or "").lower()
    hit = lambda c: any(p in c for p in ("timestamp", "ts_", "_dt", "target")) or (low and low in c) or c.endswith("_id")
    return [c for c in columns if hit(c.lower())]


#: The sentences of an audit and the steps of a cleaning plan, which users compare word for word.
ADVICE = {
    "missing": "Address missing values.",
    "duplicates": "Remove duplicate rows.",
    "constant": "Consider removing constant columns: {}",
    "high": "Review high-cardinality columns: {}",
    "imbalance": "Imbalanced classes detected in target. Consider resampling or generating synthetic data.",
    "leakage": "Evaluate potential leakage candidates: {}",
}
STEPS = {
    "missing": ("Impute missing values", "To maintain data integrity and usability."),
    "duplicates": ("Remove duplicates", "To ensure each record is unique and valid."),
    "constant": ("Remove constant columns: {}", "To reduce redundancy and improve model performance."),
    "high": ("Consider handling high cardinality columns: {}", "To prevent overfitting and improve interpretability."),
    "imbalance": ("Resample or synthesize data", "To address class imbalance and improve model training."),
    "leakage": ("Evaluate leakage candidates: {}", "To prevent data leakage in future model scoring."),
}


def audit(df: DataFrame, target: str | None = None, imbalance: float = 0.2) -> dict:
    """Dataset audit as a dict of small facts: sizes, missing, duplicates, distinct, constant and high-cardinality
    columns, class counts and imbalance, leakage candidates, recommendations."""
    n = df.count()
    lost = {r["column"]: r["missing"] for r in missing(df).collect()}  # a row for each column
    unique = {r["column"]: r["n_distinct"] for r in distinct(df).collect()}
    extra = duplicates(df).first()["duplicates"]
    constant = [c for c in df.columns if unique[c] == 1]
    high = [c for c in df.columns if unique[c] > 50 or unique[c] / max(n, 1) > 0.30]
    classes, skewed = None, False
    if target:
        balance = class_balance(df, target)
        worst = balance.agg(F.min("share").alias("s")).first()["s"]
        classes, skewed = balance, worst is not None and worst < imbalance
    leaks = leakage_candidates(df.columns, target)
    found = {"missing": any(lost.values()), "duplicates": extra > 0, "constant": constant, "high": high, "imbalance": skewed, "leakage": leaks}
    return {
        "rows": n, "columns": len(df.columns), "types": dict(df.dtypes), "missing": lost, "duplicates": extra, "distinct": unique, "constant": constant,
        "high_cardinality": high, "classes": classes, "imbalanced": skewed, "leakage": leaks, "found": found,
        "advice": [ADVICE[k].format(v) for k, v in found.items() if v],
    }


def cleaning_plan(report: dict) -> list[tuple[str, str]]:
    """(step, reason) for everything that an audit found, in the order in which steps are taken."""
    name = lambda v: ", ".join(v) if isinstance(v, list) else ""
    return [(STEPS[k][0].format(name(v)), STEPS[k][1]) for k, v in report["found"].items() if v]


def cleaned(df: DataFrame, report: dict) -> DataFrame:
    """The plan's steps applied: impute, remove duplicates, remove constant columns; the others only advise."""
    out = impute(df) if report["found"]["missing"] else df
    out = out.dropDuplicates() if report["found"]["duplicates"] else out
    return out.drop(*report["found"]["constant"])


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("t")).alias("share"))  # one row


def _median(df: DataFrame, c: str, kind: str) -> DataFrame:
    """One row with the exact median: the middle of a range-partitioned order, so no task holds all values."""
    values = df.filter(F.col(c).isNotNull()).select(F.col(c).alias("v"))
    n = values.count()
    middle = with_row_index(values, "v").filter(F.col("row_nr").isin((n - 1) // 2, n // 2))
    return middle.agg(F.avg("v").cast(kind).alias("v"))


def _mode(df: DataFrame, c: str) -> DataFrame:
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "v").limit(1).agg(F.first("v").alias("v"))


def impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric nulls become the median, other nulls the most frequent value (the smallest on ties, false for an empty
    boolean column). Each fill value is one row, found by sorted or counted partitions."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    number = lambda c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
    rest = lambda c: [F.lit(False)] if kinds[c] == "boolean" else []
    out = df
    for c in columns:
        fill = _median(df, c, kinds[c]) if number(c) else _mode(df, c)
        out = out.crossJoin(F.broadcast(fill.withColumnRenamed("v", f"__{c}")))  # one row
    return out.select(*[F.coalesce(c, f"__{c}", *rest(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def clean(df: DataFrame, drop_constant: bool = True) -> DataFrame:
    """Impute, deduplicate, drop constant columns, in that order."""
    out = impute(df).dropDuplicates()
    if drop_constant:
        fixed = [r["column"] for r in distinct(out).filter("n_distinct <= 1").collect()]  # a row for each column
        out = out.drop(*fixed)
    return out


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, r``: Pearson's r of every pair, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.select(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.inline(cells))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, n``: equal-width bins from minimum to maximum; the maximum falls in the last bin."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = df.filter(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    return x.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def looks_like_dates(df: DataFrame, column: str, sample: int = 50, least: float = 0.6) -> bool:
    """Whether at least ``least`` of the first ``sample`` values look like dates (the sample is the feature)."""
    some = df.filter(F.col(column).isNotNull()).select(column).limit(sample)
    share = some.agg(F.avg(F.col(column).cast("string").rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}").cast("int")).alias("s")).first()["s"]
    return share is not None and share >= least


def check(df: DataFrame, name: str, kind: str, actual: Column, expected=None) -> DataFrame:
    """Assertion over all rows: ``check, passed, failing``."""
    rules = {
        "equals": lambda: actual.eqNullSafe(F.lit(expected)), "contains": lambda: F.contains(actual, F.lit(expected)),
        "not_contains": lambda: ~F.contains(actual, F.lit(expected)), "greater": lambda: actual > expected, "less": lambda: actual < expected,
        "true": lambda: actual, "false": lambda: ~actual, "regex": lambda: actual.rlike(expected),
    }
    if kind == "count":
        n = df.agg(F.count(actual).alias("n"))
        return n.select(F.lit(name).alias("check"), (F.col("n") == expected).alias("passed"), F.abs(F.col("n") - expected).alias("failing"))
    bad = df.agg(F.count_if(~F.coalesce(rules[kind](), F.lit(False))).alias("failing"))
    return bad.select(F.lit(name).alias("check"), (F.col("failing") == 0).alias("passed"), "failing")
