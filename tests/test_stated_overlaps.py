"""Documents beside stated items: counted as products of matrices, without a pair of token sets ever being built."""

import pytest

from millrace.operators import similarity
from millrace.plans import catalogue


def test_overlaps_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COUNTS", 12)
    docs = [(1, 5, ["a", "b", "c"]), (2, None, []), (3, 7, ["c", "x"]), (4, 9, ["a", "b", "c", "d"])]
    items = [(10, ["a", "b", "c"]), (11, ["x"]), (12, [])]
    d, i = spark.createDataFrame(docs, "id long, n int, tokens array<string>"), spark.createDataFrame(items, "item long, tokens array<string>")
    rows = similarity.stated_overlaps(d, i).withColumn("j", similarity.overlap_jaccard()).collect()
    want = {(x, y): len(set(s) & set(w)) / len(set(s) | set(w)) if s and w else 0.0 for x, _, s in docs for y, w in items}
    assert len(rows) == 12 and {(r["id"], r["item"]): r["j"] for r in rows} == want
    some = similarity.stated_overlaps(d, i, 0.7).withColumn("j", similarity.overlap_jaccard()).filter("j >= 0.7").collect()
    assert {(r["id"], r["item"]) for r in some} == {p for p, j in want.items() if j >= 0.7}
    monkeypatch.setattr(similarity, "STATED_TOKENS", 2)
    assert similarity.stated_overlaps(d, i) is None


@pytest.mark.parametrize("name", ["mth10_answer_score", "mth10_passing_answers"])
def test_plans_join_nothing_with_the_documents(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan
