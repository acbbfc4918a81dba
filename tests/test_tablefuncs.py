"""Chunkers in SQL equal the DataFrame forms; sketches of days merge to within their stated errors."""

import random

import pytest
from pyspark.errors import AnalysisException

from millrace.operators import chunks as K
from millrace.operators import sketches, sqlguard, tablefuncs

FORMS = {
    "words": (lambda d: K.word_windows(d, size=40, overlap=5), 40, 5), "paragraphs": (lambda d: K.paragraph_chunks(d, limit=300), 300, 0),
    "tokens": (lambda d: K.token_chunks(d, size=40, overlap=5), 40, 5), "sentences": (lambda d: K.sentence_chunks(d, size=40, overlap=5), 40, 5),
    "tail": (lambda d: K.tail_chunks(d, size=300, overlap=40), 300, 40), "recursive": (lambda d: K.recursive_chunks(d, size=300, overlap=40), 300, 40),
}


@pytest.mark.parametrize("how", sorted(FORMS))
def test_lateral_chunks(spark, sf_dir, how):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("length(text) < 20000").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    docs.createOrReplaceTempView("lateral_docs")
    tablefuncs.register(spark)
    form, size, overlap = FORMS[how]
    got = sqlguard.run(spark, f"SELECT d.doc_id, c.* FROM lateral_docs d, LATERAL chunk(d.text, '{how}', {size}, {overlap}) c", limit=None)
    rows = [tuple(r)[:3] for r in got.collect()]
    assert sorted(rows) == sorted(map(tuple, form(docs).select("doc_id", "chunk_idx", "chunk").collect())) and len(rows) > 100
    assert got.columns[3] == ("n_words" if how in ("words", "tokens", "sentences") else "n_chars")


def test_calls_are_checked(spark):
    tablefuncs.register(spark)
    for call in ("chunk('a', 'none')", "chunk('a', 'words', 5, 5)", "chunk('a', 'words', -1)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018
    assert [r.chunk for r in spark.sql("SELECT * FROM chunk('a b c d', 'words', 2, 1)").collect()] == ["a b", "b c", "c d", "d"]


def test_sketches_of_days_merge(spark):
    rng = random.Random(1)
    rows = [(f"2024-01-{1 + i % 20:02d}", rng.randrange(5000), rng.gauss(50, 10)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day string, who long, v double")
    days = sketches.daily(df, "day", "who", "v")
    assert days.count() == 20
    got = sketches.estimates(sketches.merged(days), 0.5, 0.9).first()
    exact = len({w for _, w, _ in rows})
    values = sorted(v for *_, v in rows)
    rank = lambda x: sum(v <= x for v in values) / len(values)
    assert got["rows"] == 20_000 and abs(got["distinct"] - exact) <= sketches.DISTINCT_ERROR * exact
    assert abs(rank(got["q50"]) - 0.5) <= sketches.RANK_ERROR and abs(rank(got["q90"]) - 0.9) <= sketches.RANK_ERROR
