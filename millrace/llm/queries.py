"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import alignment, ann, decontaminate, langid, lexical, licences, line_dedup, lm, mixing, near_dup, pii, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _over(tables: str, op: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: op(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _over("documents", line_dedup.op1),
        "op2_near_dup": _over("documents", near_dup.op2),
        "op3_language_id": _over("documents", langid.op3),
        "op4_neighbours": _over("embeddings", ann.op4),
        "op5_toxicity": _over("documents labels", toxicity.op5),
        "op6_mixing": _over("documents", mixing.op6),
        "op7_pii": _over("documents", pii.op7),
        "op8_decontaminate": _over("documents benchmark", decontaminate.op8),
        "op9_licences": _over("documents", licences.op9),
        "op10_url_filter": _over("pages", url_filter.op10),
        "op11_lm_score": _over("documents", lm.op11),
        "op12_alignment": _over("documents", alignment.op12),
        "op13_lexical_search": _over("documents benchmark", lexical.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op9_licences": licences.oracle_sql(),
        "op10_url_filter": url_filter.ORACLE_SQL,
        "op13_lexical_search": lexical.ORACLE_SQL,
    }
