"""Searches for the vectors of stated items shuffle no vectors, however many there are, and null vectors come last as in SQL."""

import numpy as np
import pandas as pd
import pytest
from oracle import TABLES, compare, connect
from test_texts_stay import _shuffled

from millrace.operators import core
from millrace.plans import catalogue


def _folder(d, vectors, items):
    """Items share a word with one document each; ``vectors`` by id."""
    for t in TABLES.split():
        pd.DataFrame({"x": [0]}).to_parquet(d / f"{t}.parquet")
    pd.DataFrame({"item_id": range(items), "text": [f"word{i}" for i in range(items)]}).to_parquet(d / "benchmark.parquet")
    docs = [f"word{i} and more" for i in range(items)]
    pd.DataFrame({"doc_id": range(items), "text": docs, "lang": "en", "source": "s", "n_chars": [len(x) for x in docs]}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"vec_id": range(len(vectors)), "embedding": vectors, "label": 0}).to_parquet(d / "embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["ret5_hybrid", "mth7_fusion"])
def test_vectors_are_not_shuffled(spark, tmp_path, monkeypatch, name):
    size = 4000 * 64 * 4
    folder = _folder(tmp_path, list(np.random.default_rng(3).standard_normal((4000, 64), dtype=np.float32)), 5)
    monkeypatch.setattr(core, "BROADCAST_BYTES", size // 8)  # as where the table is larger than what is broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        compare(catalogue.queries()[name](spark, folder), connect(folder), catalogue.oracle_sql()[name])
        assert _shuffled(spark) - before < size / 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["ret5_hybrid", "mth7_fusion", "ret13_method_report"])
def test_null_vectors(spark, tmp_path, name):
    rng = np.random.default_rng(5)
    vectors = [None if i in (1, 4, 7, 8) else rng.standard_normal(8).astype(np.float32) for i in range(12)]
    folder = _folder(tmp_path, vectors, 3)
    compare(catalogue.queries()[name](spark, folder), connect(folder), catalogue.oracle_sql()[name])
