"""Write paths as pure DataFrame functions (plain files have no MERGE), and file sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import _hadoop_path


def upsert(base: DataFrame, patch: DataFrame, *key: str) -> DataFrame:
    """Rows of ``patch`` replace those of equal key; new keys are added. The patch has unique keys."""
    return base.join(patch, list(key), "left_anti").unionByName(patch)


def latest_by(events: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of every key: what repeated upserts leave behind."""
    w = Window.partitionBy(*key).orderBy(*order)
    return events.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def insert_ignore(base: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Only rows of keys that are not there yet are added."""
    return base.unionByName(rows.join(base, list(key), "left_anti"))


def upsert_columns(base: DataFrame, rows: DataFrame, key: str, on_conflict: dict) -> DataFrame:
    """Insert; for keys that exist only the named columns change (expressions see ``old`` and ``new`` structs)."""
    both = base.select(F.col(key), F.struct(*base.columns).alias("old")).join(rows.select(F.col(key), F.struct(*base.columns).alias("new")), key, "full")
    cols = []
    for c in base.columns:
        changed = on_conflict[c] if c in on_conflict else F.col(f"old.{c}")
        cols.append(F.when(F.col("old").isNull(), F.col(f"new.{c}")).when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(changed).alias(c))
    return both.select(*cols)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: non-null values of ``changes`` replace the base's."""
    p = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    out = base.join(p, F.col(key) == F.col("__k"), "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in out.columns else F.col(c) for c in base.columns])


def purge(base: DataFrame, condition) -> DataFrame:
    """Rows for which ``condition`` holds go; null keeps the row."""
    return base.filter(~F.coalesce(condition, F.lit(False)))


def commit(table: DataFrame, root: str) -> None:
    """The table becomes the current version below ``root``: it is written whole first, then one rename moves the pointer, so
    readers see the version before or after and never a part."""
    spark, version = table.sparkSession, f"v-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{version}")
    temporary, fs = _hadoop_path(spark, f"{root}/.CURRENT-{version}")
    out = fs.create(temporary, True)
    out.write(bytearray(version.encode()))
    out.close()
    pointer, _ = _hadoop_path(spark, f"{root}/CURRENT")
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    rename.rename(temporary, pointer, option)


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()["value"]  # one line
    return spark.read.parquet(f"{root}/{version}")


def atomic(spark: SparkSession, root: str, *steps: Callable[[DataFrame], DataFrame]) -> None:
    """Several updates of a committed table as one: all steps apply to one version and are committed together, or, where any
    of them fails, none is."""
    table = current(spark, root)
    for step in steps:
        table = step(table)
    commit(table, root)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def dual_write(stream, json_path: str, table_path: str, checkpoint: str):
    """A stream written twice per micro-batch: JSON lines and Parquet."""

    def both(batch: DataFrame, _: int) -> None:
        batch.persist()
        append_json(batch, json_path)
        batch.write.mode("append").parquet(table_path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


def write_index(chunks: DataFrame, path: str, buckets: int = 32) -> None:
    """A chunk or vector index as Parquet partitioned by a hash of its id."""
    chunks.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_postings(postings: DataFrame, path: str, buckets: int = 32) -> None:
    """A lexical index saved: postings as Parquet partitioned by a hash of their term, so a query reads its terms' buckets."""
    postings.withColumn("bucket", term_bucket(F.col("term"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def term_bucket(term, buckets: int = 32):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
