"""A corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, source mixing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and returns the columns of
``documents`` (the last one adds ``copy_no`` and ``shuffle_key``). Between stages the rows are written as Parquet and
read again, so a lost executor costs one stage at most.

Defined results: null or empty texts are rejected by the first stage (they have no language); a table without rows
passes through every stage; columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, line_dedup, mixing, near_dup
from millrace.session import materialise, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Confidence below which a document counts as being in no language that the labels teach.
MIN_LANGUAGE_SCORE = 0.5


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; ``lang`` becomes the predicted one."""
    docs = docs.select(*COLUMNS)
    out = langid.identify(docs).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANGUAGE_SCORE))
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has nothing left but white space goes with them."""
    return _sized(line_dedup.line_dedup(docs)).filter(F.length(F.btrim("text", F.lit(line_dedup.STRIP))) > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word shingles and similarity 0.8."""
    return near_dup.keep_one(docs, k=5, percent=80).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("mixture", mixture),
]

#: The classifier and the similarity join have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = materialise(docs, f"stage-{name}")
            if before:
                remove(spark, before)  # a written stage no longer reads its predecessor
            before = path
    return docs
