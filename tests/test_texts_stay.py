"""Searches over documents do not shuffle their texts: what was found goes to the documents."""

import random

import pandas as pd
import pytest
from oracle import TABLES, compare, connect

from millrace.plans import catalogue

NAMES = ["mth11_precision_recall", "win11_reciprocal_rank", "win12_ndcg", "ret11_metrics", "jon14_relevant_found", "jon8_rerank_pairs", "ret8_rerank", "jon5_id_lookup"]


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    """300 documents of 400 words, each of which only one holds; items are passages of some. The folder, and the bytes of text."""
    d, rng = tmp_path_factory.mktemp("texts"), random.Random(4)
    words = [[f"{rng.getrandbits(40):x}" for _ in range(400)] for _ in range(300)]
    docs = [" ".join(w) for w in words]
    items = [" ".join(words[i * 7][40:60]) for i in range(5)]
    docs += [f"{docs[3]} {items[2]} x"] * 2 + [None, ""]
    for t in TABLES.split():
        pd.DataFrame({"x": [0]}).to_parquet(d / f"{t}.parquet")
    pd.DataFrame({"item_id": range(5), "text": items}).to_parquet(d / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(len(docs)), "text": docs, "lang": "en", "source": "s", "n_chars": [len(x or "") for x in docs]}).to_parquet(d / "documents.parquet")
    return str(d), sum(len(x or "") for x in docs)


def _shuffled(spark):
    """Bytes shuffled by all stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", NAMES)
def test_texts_are_not_shuffled(spark, texts, name):
    folder, size = texts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at sizes where nothing is broadcast unasked
    try:
        before = _shuffled(spark)
        compare(catalogue.queries()[name](spark, folder), connect(folder), catalogue.oracle_sql()[name])
        assert _shuffled(spark) - before < size / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
