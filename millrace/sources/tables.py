"""Readers: driver tables, files, catalog, and the trade view that the ledger operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.fold import fold
from millrace.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: account, symbol, side, quantity, signed quantity, price and a unique order."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    sell = F.col("l_returnflag") == "R"
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "account",
        F.col("l_partkey").alias("symbol"),
        F.when(sell, "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        F.when(sell, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("signed"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


TRADE_ORDER = ["ts", "l_orderkey", "l_linenumber", "symbol", "l_suppkey"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, missing_ok: bool = False) -> DataFrame:
    """CSV with a header; types are inferred where no schema is given. ``missing_ok`` gives an empty frame for a path
    that does not exist, with the schema asked for."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return _or_empty(spark, lambda: reader.csv(path), schema, missing_ok)


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True, missing_ok: bool = False) -> DataFrame:
    """A JSON document (or array of them) per file; ``multi_line=False`` reads JSON lines and drops malformed ones."""
    reader = spark.read.option("multiLine", multi_line)
    reader = reader if multi_line else reader.option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema else reader
    return _or_empty(spark, lambda: reader.json(path), schema, missing_ok)


def _or_empty(spark, read, schema, missing_ok: bool) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema or T.StructType([]))
        raise


def read_tree(spark: SparkSession, folder: str, glob: str = "*.json", schema=None) -> DataFrame:
    """All matching JSON files below a folder, with the file each row came from."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True)
    reader = reader.schema(schema) if schema else reader
    return reader.json(folder).withColumn("source_file", F.col("_metadata.file_path"))


def read_traces(spark: SparkSession, folder: str, schema) -> DataFrame:
    """JSON-lines traces of the ``trace_*.jsonl`` files of a folder, bad lines skipped, the last file name first."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "trace_*.jsonl").option("recursiveFileLookup", True).json(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_name")).orderBy(F.desc("source_file"))


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query pushed to a JDBC source."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def with_row_index(df: DataFrame, *order: str, name: str = "row_nr") -> DataFrame:
    """0-based index over an explicit order, without a single-task sort: the rows are range-partitioned and written with
    their place in their partition, and the partitions' sizes are added up. Written, so both uses see one partitioning."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    part = part.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    part, _ = materialise(part, "indexed")
    sizes = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(before.select("__p", F.coalesce("__before", F.lit(0)).alias("__before")))  # one row a partition
    return part.join(before, "__p").withColumn(name, F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")


def coerced(df: DataFrame, kinds: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Text columns of a sheet as typed ones; what does not parse becomes the default (or null)."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).try_cast(k), F.lit((defaults or {}).get(c)).cast(k)) for c, k in kinds.items()}
    )


def captions(lines: DataFrame, text: str = "text") -> DataFrame:
    """WebVTT cues: ``start_time, end_time, body`` from whole-file text."""
    blocks = lines.select(*[c for c in lines.columns if c != text], F.posexplode(F.split(F.col(text), r"\r?\n[ \t]*\r?\n")).alias("cue", "block"))
    stamp = r"(?m)^((?:\d+:)?\d{1,2}:\d{2}\.\d{3})\s+-->\s+((?:\d+:)?\d{1,2}:\d{2}\.\d{3})[^\n]*\n?"
    body = F.regexp_replace(F.col("block"), r"(?s)^.*?-->[^\n]*\n?", "")
    return blocks.filter(F.col("block").rlike(stamp)).select(
        *[c for c in blocks.columns if c != "block"],
        F.regexp_extract("block", stamp, 1).alias("start_time"),
        F.regexp_extract("block", stamp, 2).alias("end_time"),
        F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", ""), r"\s+", " ")).alias("body"),
    )


def page_rows(blocks: DataFrame, *page: str, tolerance: float = 5.0) -> DataFrame:
    """Lines of a page from text blocks ``x, y, body``: blocks belong to a row while their y lies within ``tolerance``
    of the row's *first* block; cells run left to right, joined by `` | ``. An ordered fold over each page."""
    b = blocks.filter(F.trim("body") != "").select(*page, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "body")

    def fresh():
        row, top = -1, None

        def step(y):
            nonlocal row, top
            if top is None or abs(y - top) > tolerance:
                row, top = row + 1, y
            return (row,)

        return step

    cells = fold(b.filter("x IS NOT NULL AND y IS NOT NULL"), list(page), ["y", "x", "body"], ["y"], fresh, "row int")
    cell = F.trim(F.regexp_replace("body", r"\s*\n\s*", " "))
    rows = cells.groupBy(*page, "row").agg(F.array_sort(F.collect_list(F.struct(F.col("x"), cell.alias("body")))).alias("cs"))
    return rows.select(*page, "row", F.array_join(F.transform("cs", lambda c: c["body"]), " | ").alias("line"))


def mock_prices(spark: SparkSession, symbol: str, anchor: str, days: int = 30, seed: int = 1) -> DataFrame:
    """Synthetic open, high, low, close and volume rows; equal seeds give equal rows."""
    r = lambda n, lo, hi: F.round(lo + F.rand(seed + n) * (hi - lo), 2)
    rows = spark.range(days).select(F.lit(symbol).alias("symbol"), F.date_sub(F.lit(anchor).cast("date"), F.col("id").cast("int")).alias("day"), r(0, 90, 110).alias("open"), r(1, 90, 110).alias("close"))
    return rows.withColumn("high", F.greatest("open", "close") + 1).withColumn("low", F.least("open", "close") - 1).withColumn("volume", F.floor(F.rand(seed + 9) * 1e6).cast("long"))


def catalog(spark: SparkSession) -> DataFrame:
    """``table, column, type`` of every table and view in the current database."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "`table` string, `column` string, `type` string")
