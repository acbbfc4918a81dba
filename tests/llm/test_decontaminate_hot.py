"""Seeds that many items hold: linear in documents and items, equal to brute force."""

import random

from test_learned_operators import overlaps_brute

from millrace.llm import decontaminate

PHRASE = "which of the following best describes the meaning of the"


def _templated(n, seed):
    rng = random.Random(seed)
    some = lambda: [f"v{rng.randrange(10**7)}" for _ in range(12)]
    return [" ".join([*some(), PHRASE, *some()]) for _ in range(n)]


def _alignments(spark, docs_of, n):
    docs = docs_of([*_templated(n, 1), *_templated(5, 2)], clash=False)
    bench = spark.createDataFrame(list(enumerate(_templated(n, 2))), "item_id long, text string")
    kept, held = [], decontaminate._alignments

    def counted(*a):
        kept.append(held(*a))
        return kept[-1]

    decontaminate._alignments = counted
    try:
        found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    finally:
        decontaminate._alignments = held
    assert found >= {(n + i, i) for i in range(5)} and len(found) < 20
    return kept[0].count()


def test_a_template_of_all_items_stays_linear(spark, docs_of):
    small, large = _alignments(spark, docs_of, 500), _alignments(spark, docs_of, 1000)
    assert large < 10 * 1000 and large <= 2.5 * max(small, 50)


def test_hot_seeds_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT_ITEMS", 1)
    rng = random.Random(5)
    words = [f"q{i}" for i in range(40)]
    shared = rng.choices(words, k=11)
    items = [" ".join([*rng.choices(words, k=a), *shared[rng.randrange(4) :], *rng.choices(words, k=rng.randrange(6))]) for a in (0, 0, 1, 2, 3, 5, 8, 13) for _ in range(3)]
    items += [" ".join(shared[:n]) for n in (3, 6, 8, 9, 10, 11)] + [items[0], None, ""]
    texts = [None, "", items[3]]
    for _ in range(60):
        part = rng.choice(items[:-3]).split()
        for at in rng.sample(range(len(part)), len(part) // rng.choice([3, 5, 50])):
            part[at] = "swapped"
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(8)), *part, *rng.choices(words, k=rng.randrange(8))]))
    want = {(d, i, *got) for d, t in enumerate(texts) for i, x in enumerate(items) if (got := overlaps_brute(t, x))}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(want) > 200
    assert set(map(tuple, decontaminate.overlaps(docs_of(texts), bench).collect())) == want
