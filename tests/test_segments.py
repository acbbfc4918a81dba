"""A growing index ranks as one that is built at once."""

import math
import random

from pyspark.sql import functions as F

from millrace.operators import blockmax, retrieval, segments


def _top(df):
    return sorted(map(tuple, retrieval.top(df.withColumn("score", F.round("score", 8)), 6).select("query_id", "id", "score", "rank").collect()))


def test_appends_deletes_and_merges(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    say = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.choice([1, 6, 25])))
    queries = spark.createDataFrame([(i, say()) for i in range(8)] + [(8, "nowhere"), (9, None)], "query_id long, query string")
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(segments, "FAN", 2)
    monkeypatch.setattr(blockmax, "DIRECT_PAIRS", 0)
    index = segments.SegmentIndex(spark, str(tmp_path / "index")).create()
    assert index.search(queries, 6).count() == 0
    held = {}

    def append(ids):
        new = {i: say() for i in ids}
        held.update(new)
        index.append(frame(list(new.items())))

    def check():
        assert _top(index.search(queries, 6)) == _top(retrieval.bm25(frame(list(held.items())), queries))

    append(range(0, 40))
    append(range(40, 50))
    append([3, 4, 60])  # two are replaced
    check()
    for i in (0, 3, 41, 60, 999):
        held.pop(i, None)
    index.delete(frame([(i, "") for i in (0, 3, 41, 60, 999)]))
    check()
    append([0, 61, 62])  # one comes back
    append([63])
    append([64, 65])
    check()
    rows = index.manifest()
    sizes = [int(math.log2(r[3])) for r in rows if r[0] == "segment"]
    assert len(sizes) == len(set(sizes)) < 6 and sum(r[3] for r in rows if r[0] == "segment") >= len(held)  # below FAN of each class
    index.append(frame([]))
    index.delete(frame([]))
    check()
    assert sorted(r.id for r in index.alive("lengths").collect()) == sorted(held)


def test_appends_shuffle_no_postings_and_large_query_sets_rank_alike(spark, tmp_path, monkeypatch):
    texts = [(0, "b a a"), (1, ""), (2, None), (3, "a c"), (4, "c c c d"), (5, "é a")]
    frame = spark.createDataFrame(texts, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(0, "a"), (1, "c d a a"), (2, "é b")], "query_id long, query string")
    written = []
    real = segments.SegmentIndex._segment
    monkeypatch.setattr(segments.SegmentIndex, "_segment", lambda self, rows: written.append(rows._jdf.queryExecution().toString()) or real(self, rows))
    index = segments.SegmentIndex(spark, str(tmp_path / "index")).create()
    index.append(frame.filter("id < 4"))
    index.append(frame.filter("id > 2"))
    assert len(written) == 2 and all("groupBy" not in p and "Aggregate" not in p for p in written)  # postings were dealt by chunk, then by bucket
    assert sorted((r.id, r.len) for r in index.alive("lengths").collect()) == [(0, 3), (1, 0), (2, 0), (3, 2), (4, 4), (5, 2)]
    want = _top(retrieval.bm25(frame, queries))
    assert _top(index.search(queries, 6)) == want and len(want) > 6
    monkeypatch.setattr(blockmax, "IN_TASKS", 1)
    assert _top(index.search(queries, 6)) == want
