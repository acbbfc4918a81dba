"""Operators without an SQL form: against brute force, planted cases and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, decontaminate, langid, near_dup, pii, textvec, toxicity

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- near duplicates ---


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(df, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_dup(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_near_dup_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check_near(docs, [(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_near_dup_large_groups(docs_of):
    """A dense group beyond the size of small nodes, with graded similarity, next to look-alikes and copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=120)
    texts = []
    for i in range(420):
        t = list(base)
        for _ in range(i % 9):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 30 + [" ".join(rng.choices(words, k=60)) for _ in range(60)] + ["A b", "a B", "a b c", "", None]
    rng.shuffle(texts)
    check_near(docs_of(texts), list(enumerate(texts)), 3, 85)


def brute_by_shingle(rows, k, percent):
    """The same as ``brute`` by way of an inverted index, for larger tables."""
    sets = {i: shingles(t, k) for i, t in rows}
    root, held, first = {i: i for i in sets}, {}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(sets):
        near = {}
        key = frozenset(sets[i])
        if key and key in first:
            near[first[key]] = len(key)
        elif key:
            first[key] = i
            for s in key:
                for j in held.get(s, ()):
                    near[j] = near.get(j, 0) + 1
                held.setdefault(s, []).append(i)
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_dup_recall_on_a_larger_table(spark, k, percent):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_by_shingle([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_dup(docs, k, percent).collect()}
    assert got == want


def test_near_dup_odd(odd):
    out = near_dup.near_dup(odd)
    assert out.count() == odd.count()
    rows = out.collect()
    assert all(r.kept for r in rows if r.doc_id is None or r.n_shingles == 0)
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (5, 7, 9)").count() == 0
    assert near_dup.near_dup(odd.limit(0)).count() == 0


def _template(n, swaps, seed=4, words=198):
    """Documents of one template with ``swaps`` words replaced, at other places in each: with five all look alike, and none
    links at 85 per cent."""
    rng = random.Random(seed)
    base, out, taken = [f"b{i}" for i in range(words)], [], set()
    while len(out) < n:
        places = tuple(sorted(rng.sample(range(1, words - 1, 3), swaps)))  # no shingle holds two of them
        if places not in taken:
            taken.add(places)
            out.append(" ".join(f"x{len(out)}y{i}" if i in places else w for i, w in enumerate(base)))
    return out


def test_near_dup_templates_are_sent_a_fixed_number_of_times(docs_of, monkeypatch):
    sent, links = {}, near_dup._links
    for n in (150, 600, 2400):
        sent[n] = 0

        def counted(stream, *a, n=n):
            sent[n] += stream.count()
            return links(stream, *a)

        monkeypatch.setattr(near_dup, "_links", counted)
        out = near_dup.near_dup(docs_of(_template(n, 5), clash=False), 3, 85)
        assert out.filter("NOT kept").count() == 0
    assert all(sent[n] <= 16 * n for n in sent), sent


def test_near_dup_blocks_and_large_nodes_agree(docs_of, monkeypatch):
    """Nodes too large for a task branch by exchanges, and groups too large for a task meet block by block."""
    texts = _template(150, 4) + _template(60, 9, seed=6) + _template(28, 1, seed=8, words=90)
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dup, "NODE_ROWS", 40)
    monkeypatch.setattr(near_dup, "LEAF", 16)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(near_dup, "EDGES_IN_ONE", 0)
    check_near(docs_of(texts, clash=False), rows, 3, 85)


def test_forest_links_what_brute_force_links():
    rng = random.Random(12)
    for _ in range(30):
        base = [rng.sample(range(4000), 60) for _ in range(3)]
        sets = [np.unique(np.array([x if rng.random() > rng.choice([0.02, 0.06, 0.1]) else rng.randrange(9000) for x in rng.choice(base)], np.uint64)) for _ in range(rng.randrange(2, 90))]
        m = len(sets)
        edges = {(x, y) for x in range(m) for y in range(x + 1, m) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))}
        label = near_dup._components(m, *(np.array([e[i] for e in edges], int) for i in (0, 1))) if edges else np.arange(m)
        found = near_dup._forest(sets, np.arange(m) + 100, 85, np.ones(m, int))
        assert {tuple(sorted(f)) for f in found} <= edges
        got = near_dup._components(m, *(np.array([f[i] for f in found], int) for i in (0, 1))) if found else np.arange(m)
        assert (got == label).all() and len(found) == m - len(set(label.tolist()))


# --- text primitives ---


def test_words_and_shingles_follow_the_definition():
    texts = ["", "A b\tC", " x ", "é É", "a\x0bb c d", "one", "A b\tC", None, "x" * 5000]
    col = pa.array(texts)
    sets = list(near_dup._sets(col, 3))
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert (sets[1] == sets[6]).all() and np.isin(sets[1], sets[4]).all()
    words = textvec.hash_words(["a", "A", "b"])
    assert words[0] == words[1] != words[2]


# --- language ---


def test_language_held_out(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    got = langid.op3(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["acc"] >= 0.95 and 0 <= r["lo"] <= r["hi"] <= 1
    out = langid.identify(odd)
    assert out.count() == odd.count() and set(out.columns) == {*odd.columns, "lang_pred", "lang_score"}
    assert out.filter("text IS NULL OR trim(text) = ''").filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(odd.limit(0)).count() == 0
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_pairs_stay_within_a_family():
    m = langid.fit(["der die das", "the of and", "le la les", "el los las"] * 6, ["de", "en", "fr", "es"] * 6)
    assert m.families == ["germanic", "romance"] and {p[1:] for p in m.pairs} == {("de", "en"), ("es", "fr")}


def test_language_votes_against_brute_force():
    """Margins from n-grams counted one by one, and the votes of the pairs within the best family."""
    rng = random.Random(8)
    words = {"de": "der die das und ist ein nicht", "en": "the of and to is that in", "nl": "de het een en van niet", "fr": "le la les des une est et", "es": "el los las una es y de"}
    texts = [(" ".join(rng.choices(words[lang].split(), k=30)), lang) for lang in words for _ in range(12)]
    m = langid.fit([t for t, _ in texts], [lang for _, lang in texts])
    assert m.families == ["germanic", "romance"] and len(m.pairs) == 4
    some = [t for t, _ in texts[::3]] + ["", "Ünd 12 THE", "x"]
    b, off = textvec.raw(pa.array(some))
    got = langid.margins(m, b, off)
    for i, t in enumerate(some):
        folded = [int(langid._FOLD[x]) for x in t.encode()]
        counts = {}
        for n in range(1, 5):
            for j in range(len(folded) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (folded[j + k] + k * 257 + 1)
                h = ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.BITS
                counts[h] = counts.get(h, 0) + 1
        total = sum(counts.values())
        want = m.bias + sum((np.sqrt(n / total) * m.weights[h].astype(float) for h, n in counts.items()), np.zeros(len(m.bias)))
        assert got[i] == pytest.approx(want, abs=1e-4)
    langs, scores = langid.decide(m, got)
    for i, lang in enumerate(langs):
        family = m.families[int(np.argmax(got[i][:2]))]
        votes = {x: 0 for x in m.languages[family]}
        for j, (f, a, c) in enumerate(m.pairs):
            if f == family:
                votes[a if got[i][2 + j] > 0 else c] += 1
        assert votes[lang] == max(votes.values()) and 0 <= scores[i] <= 1
    assert langs[: len(texts[::3])] == [lang for _, lang in texts[::3]]


def test_every_language_is_learnt(docs_of, monkeypatch):
    """More languages than the shared sample has rows for: each still has its own texts in it."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 20)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"{a}{b} " * 9 + f"{a}{i}", f"q{a}{b}") for a in letters[:6] for b in letters[6:11] for i in range(10)]
    docs = docs_of([t for t, _ in rows], clash=False)
    named = docs.withColumn("lang", F.element_at(F.array(*[F.lit(x) for _, x in rows]), (F.col("doc_id") + 1).cast("int")))
    got = langid.sample(named, F.lit(True), "text", "lang").groupBy("lang").count().collect()
    assert len(got) == 30 and all(r["count"] == langid.LEAST_EACH for r in got)


# --- neighbours ---


def test_neighbours_recall(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    got = ann.op4(e)
    pdf = e.toPandas()
    x = np.stack(pdf.embedding).astype(float)
    ids = pdf.vec_id.to_numpy()
    norm = np.linalg.norm(x, axis=1)
    hits = total = 0
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (norm * norm[q])
        s[q] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = sorted(found[ids[q]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m[2] - s[np.flatnonzero(ids == m[1])[0]]) < 1e-12 for m in mine)
        hits, total = hits + len(best & {m[1] for m in mine}), total + 5
    assert hits / total >= 0.9


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "'x' AS score")
    got = ann.op4(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 50), (0, 3, 8), (50, 1, 0), (50, 2, 1), (50, 3, 8)]
    assert ann.op4(df.limit(0)).count() == 0


def test_blocks_of_a_part_agree(spark, sf_dir, monkeypatch):
    """Parts cut into several blocks, and queries dealt to several tasks, find the same neighbours."""
    e = table(spark, sf_dir, "embeddings")
    want = sorted(map(tuple, ann.op4(e).collect()))
    monkeypatch.setattr(ann, "BLOCK_VALUES", 1)
    monkeypatch.setattr(ann, "PAIRS", 16)
    assert sorted(map(tuple, ann.op4(e).collect())) == want


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(400, 8))
    label = ann.partition(ann._neighbours(x / np.linalg.norm(x, axis=1, keepdims=True), 8), 8)
    assert np.bincount(label).tolist() == [50] * 8


# --- toxicity ---


def segments_brute(w):
    """All maximal scoring segments by the definition: the best of the whole, then the same left and right of it."""
    if not len(w) or max(w) <= 0:
        return []
    best = max(((sum(w[i:j]), -(j - i), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), key=lambda z: (round(z[0], 9), z[1]))
    _, _, i, j = best
    return [*segments_brute(w[:i]), (i, j), *[(a + j, b + j) for a, b in segments_brute(w[j:])]]


def test_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.normal(-0.3, 1.0, rng.integers(0, 18))
        assert [(s, e) for s, e, _ in toxicity.segments(w)] == segments_brute(w.tolist())


def test_toxicity_planted(spark, docs_of, odd):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(600):
        t = rng.choices(plain, k=60)
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            t[rng.randrange(60)] = rng.choice(["vile", "nasty", "scummy"])
        texts.append(" ".join(t))
        marks.append((i, int(toxic), 1))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    out = toxicity.op5(docs_of(texts), labels).join(labels, "doc_id")
    assert out.filter("held_out AND predicted <> toxic").count() == 0
    model = toxicity.fit(toxicity.labelled(docs_of(texts), labels, F.lit(True)))
    scored = toxicity.score_texts(docs_of(["so é vile, nasty thing", None, ""]), model).orderBy("doc_id").collect()
    text, p = "so é vile, nasty thing", scored[0].passages
    assert [text[x.start : x.end] for x in p] == ["vile, nasty"] and scored[1].score == scored[2].score < 0.5
    assert toxicity.op5(odd, labels).count() == odd.count()
    assert toxicity.op5(odd.limit(0), labels.limit(0)).count() == 0
    assert toxicity.op5(odd, labels.limit(0)).filter("score < 0 OR score > 1").count() == 0


def test_toxicity_scores_against_brute_force(spark, docs_of):
    """Weights, segments, extreme values and the logistic map, each by its definition in plain Python."""
    import math

    rng = random.Random(11)
    plain = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(300):
        t = rng.choices(plain, k=rng.randrange(10, 60))
        for _ in range(3 * (i % 4 == 0)):
            t[rng.randrange(len(t))] = rng.choice(["vile", "nasty"])
        rows.append((" ".join(t), int(i % 4 == 0)))
    m = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    n1, n0 = ({w: sum(w in t.split() for t, y in rows if y == side) for t, _ in rows for w in t.split()} for side in (1, 0))
    t1, t0 = sum(n1.values()), sum(n0.values())
    prior, want = toxicity.PRIOR_SHARE * min(t1, t0), {}
    for w in n1:
        share = prior * (n1[w] + n0[w]) / (t1 + t0)
        a, b = n1[w] + share, n0[w] + share
        odds = math.log(a / (t1 + prior - a)) - math.log(b / (t0 + prior - b))
        if odds > toxicity.W_MIN and odds / math.sqrt(1 / a + 1 / b) > toxicity.Z_MIN:
            want[w] = odds
    keys = textvec.hash_words(sorted(want), table=textvec.ALNUM)
    assert dict(zip(m.keys.tolist(), m.weights.tolist(), strict=True)) == pytest.approx(dict(zip(keys.tolist(), [want[w] for w in sorted(want)], strict=True)))

    def score(text):
        words = text.split()
        w = [want.get(x, toxicity.DRIFT) for x in words]
        p = [-math.expm1(-math.exp(-(sum(w[i:j]) - m.mu0 - m.mu1 * math.log(max(len(w), 1))) / m.beta)) for i, j in segments_brute(w)]
        strong = [-math.log(max(x, 1e-300)) for x in p if x < toxicity.P_SEGMENT]
        total = sum(strong) if strong else 0.1 * max([-math.log(max(x, 1e-300)) for x in p], default=0.0)
        return 1 / (1 + math.exp(-m.slope * (total - m.cut)))

    texts = ["", *(t for t, _ in rows[:40])]
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs_of(texts), m).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([score(t) for t in texts], abs=1e-6)


# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_brute(t):
    def ok(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if ok(k, m[0])]
    return ",".join(x for *_, x in sorted(found))


def test_base_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op7(docs).collect():
        assert r.base_sha256 == hashlib.sha256(base_brute(texts[r.doc_id]).encode()).hexdigest()
        assert set(base_brute(texts[r.doc_id]).split(",")) <= set(r.spans.split(","))


def test_base_spans_random():
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choices("ab@.%+-0123 59()é\n", k=60))
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(t)) == base_brute(t)


FILLER = "plain words of every day stand here"


def _disclosed(df, texts):
    return {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in pii.find(df).collect() for s in r.spans if s.kind == pii.TERM}


def test_disclosing_terms(docs_of, odd):
    texts = [f"{FILLER} the astronaut wrote to neil@moon.org {FILLER}" for _ in range(4)] + [f"{FILLER} {i} more" for i in range(60)]
    terms = {w for _, w in _disclosed(docs_of(texts), texts)}
    assert "astronaut" in terms and "plain" not in terms
    clean = pii.sanitise(docs_of(texts)).orderBy("doc_id").first()
    assert "neil@" not in clean.text and "astronaut" not in clean.text and "[EMAIL]" in clean.text and clean.spans == "x"
    assert pii.op7(odd).count() == odd.count() and pii.op7(odd.limit(0)).count() == 0


def test_terms_are_found_in_every_line(docs_of):
    """A telling word is one wherever it stands in the document, and standing there twice does not weaken it."""
    rest = [f"{FILLER} {i} more" for i in range(60)]
    texts = [f"{FILLER} the astronaut wrote to neil@moon.org {FILLER}\n{FILLER} an astronaut again\n{FILLER}" for _ in range(4)] + rest
    got = pii.find(docs_of(texts)).filter("doc_id = 0").first()
    assert [texts[0][s.start : s.end] for s in got.spans if s.kind == pii.TERM].count("astronaut") == 2
    assert "astronaut" not in pii.sanitise(docs_of(texts), remove_terms=True).filter("doc_id = 0").first().text
    assert not _disclosed(docs_of(texts[:1] + rest), texts[:1] + rest)  # one document is no support


def test_terms_against_brute_force(docs_of):
    import math

    rng = random.Random(4)
    names = ["a@b.co", "c@d.org", "10.2.3.4", "5f8a1c9be07d4426b3ae9d01c7f2688e"]
    texts = []
    for i in range(120):
        lines = [" ".join(rng.choices([f"w{j}" for j in range(40)] + [f"rare{j}x" for j in range(12)], k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 5))]
        if i % 5 == 0:
            e = rng.randrange(4)
            lines[0] += f" told{e} {names[e]}"
        texts.append("\n".join(lines))
    ents = [{n for n in names if n in t} for t in texts]
    word = lambda t: set(re.findall("[A-Za-z0-9]{3,}", t))
    near = [{(n, w) for line in t.split("\n") for n in names if n in line for w in word(line.replace(n, " "))} for t in texts]
    n_e = {n: sum(n in e for e in ents) for n in names}
    risky = set()
    for n, w in set().union(*near):
        n_et, n_t = sum((n, w) in p for p in near), sum(w in word(t) for t in texts)
        if n_et >= 2 and math.log(n_et * len(texts) / (n_e[n] * n_t)) >= pii.ALPHA * math.log(len(texts) / n_e[n]):
            risky.add((n, w))
    want = {(i, w) for i, t in enumerate(texts) for n, w in risky if n in t and w in word(t.replace(n, " "))}
    assert want and _disclosed(docs_of(texts), texts) == want


def test_secrets(docs_of):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'of token = "{key}" and', "a" * 40, "internationalisation2020conference", "1234567890123456789012345", f"x{key}@mail.org"]
    got = {r.doc_id: r for r in pii.op7(docs_of(texts)).collect()}
    assert got[0].spans == f"secret:12:52" and got[0].n_secret == got[0].n_spans == 1
    assert [got[i].n_secret for i in range(1, 5)] == [0, 0, 0, 0] and got[4].n_email == 1


def test_sanitise_repeated_and_null_ids(docs_of):
    rows = [(1, "a@b.co x"), (1, "quite another text"), (None, "mail c@d.org"), (2, "a@b.co x"), (2, "a@b.co x"), (3, None), (4, "")]
    docs = docs_of(rows).withColumn("k1", F.lit("k")).withColumn("doc", F.lit("d")).withColumn("clean", F.lit("c"))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.filter("k1 = 'k' AND doc = 'd' AND clean = 'c'").count() == 7
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [
        (0, "mail [EMAIL]"), (1, "[EMAIL] x"), (1, "quite another text"), (2, "[EMAIL] x"), (2, "[EMAIL] x"), (3, ""), (4, "")
    ]


# --- decontamination ---


def test_decontamination_planted(spark, docs_of, odd):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(4000)]
    items = [" ".join(rng.choices(words, k=n)) for n in (40, 25, 16, 9, 5)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    fill = lambda: " ".join(rng.choices(words, k=80))
    swapped = items[0].split()
    for at in (3, 14, 25, 36):
        swapped[at] = "other"
    texts = [fill() for _ in range(40)]
    texts[3] = f"{fill()} {items[0].upper()}! {fill()}"
    texts[7] = f"{fill()} {' '.join(swapped)} {fill()}"
    texts[11], texts[12], texts[13], texts[14] = (f"{fill()}, {x}. {fill()}" for x in items[1:])
    texts[15] = " ".join(items[0].split()[5:30])
    texts[20] = " ".join(w if i % 2 else "other" for i, w in enumerate(items[0].split()))
    got = {r.doc_id: r.item_ids for r in decontaminate.op8(docs_of(texts), bench).filter("contaminated").collect()}
    assert got == {3: "0", 7: "0", 11: "1", 12: "2", 13: "3", 14: "4", 15: "0"}
    left = decontaminate.decontaminate(docs_of(texts), bench)
    assert left.count() == 33 and left.columns == docs_of(texts).columns
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.op8(odd.limit(0), bench).count() == 0 and decontaminate.op8(odd, bench.limit(0)).filter("contaminated").count() == 0


def overlaps_brute(text, item):
    """(covered, agreeing, item words, at) by the definition: any alignment with a seed in common, the best window on it."""
    cut = lambda t: re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    d, w = cut(text), cut(item)
    n, best = len(w), None
    for diagonal in range(-n + 1, len(d)) if n else ():
        same = [0 <= diagonal + i < len(d) and d[diagonal + i] == w[i] for i in range(n)]
        inside = [0 <= diagonal + i < len(d) for i in range(n)]
        if n < decontaminate.SHORT:
            new = (n, n, -diagonal, n) if all(same) else None
        else:
            seeded = any(all(same[i + j] for j, bit in enumerate(m) if bit == "1") and all(inside[i : i + len(m)]) for m in decontaminate.MASKS for i in range(n - len(m) + 1))
            size = min(decontaminate.WINDOW, n)
            good = [i for i in range(n - size + 1) if all(inside[i : i + size]) and sum(same[i : i + size]) >= np.ceil(decontaminate.MIN_MATCH * size)]
            covered = {i + j for i in good for j in range(size)}
            new = (len(covered), sum(same[i] for i in covered), -max(0, diagonal), n) if seeded and good else None
        if new and (best is None or new > best):
            best = new
    return best and (best[0], best[1], best[3], -best[2])


def test_decontamination_against_brute_force(spark, docs_of, monkeypatch):
    rng = random.Random(21)
    words = [f"q{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 7, 8, 12, 13, 20, 40]))) for _ in range(30)]
    items += [items[0], items[9], "", None]
    texts = [None, "", items[20], items[20]]
    for _ in range(60):
        t = rng.choices([f"z{i}" for i in range(50)] + words, k=rng.randrange(5, 60))
        part = rng.choice(items[:30]).split()
        for at in rng.sample(range(len(part)), len(part) // rng.choice([3, 6, 50])):
            part[at] = "swapped"
        at = rng.randrange(len(t))
        texts.append(" ".join(t[:at] + part[rng.randrange(3) :] + t[at:]).title())
    docs, bench = docs_of(texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = {(d, i, *got) for d, t in enumerate(texts) for i, x in enumerate(items) if (got := overlaps_brute(t, x))}
    assert len(want) > 60
    assert set(map(tuple, decontaminate.overlaps(docs, bench).collect())) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "FILTER_POWER", 16)  # false positives
    assert set(map(tuple, decontaminate.overlaps(docs, bench).collect())) == want


def test_decontamination_judges_texts(spark, sf_dir, docs_of):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()))
    assert {(r[0], r[1]) for r in whole} >= {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    item = bench.first().text
    rows = docs_of([(None, item), (1, item), (1, "clean words only"), (2, item), (2, item)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.contaminated) for r in decontaminate.op8(rows, bench).collect()) == [
        (False, 1, False), (False, 1, True), (False, 2, True), (False, 2, True), (True, 0, True)
    ]
    left = decontaminate.decontaminate(rows.withColumn("k1", F.lit("a")).withColumn("doc", F.lit("b")), bench).collect()
    assert [(r.doc_id, r.text, r.k1, r.doc) for r in left] == [(1, "clean words only", "a", "b")]


# --- pipeline ---


def test_pipeline_stages(spark, sf_dir, docs_of):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns[:5] == p.COLUMNS and (n == 4 or len(out.columns) == 5)
        rows = {r.doc_id: r.text for r in out.collect()}
        before = {r.doc_id: r.text for r in docs.collect()}
        if name in ("language", "near_duplicates", "benchmark_free"):
            assert rows.items() <= before.items()
        if name == "near_duplicates":
            assert set(rows) == {i for i, (_, c) in brute(before.items(), 5, 80).items() if i == c}
        if name == "benchmark_free":
            items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
            assert not any(x in t for t in rows.values() for x in items)
        docs = spark.createDataFrame(out.select(p.COLUMNS).dropDuplicates(["doc_id"]).collect(), out.select(p.COLUMNS).schema) if n < 4 else out
    assert set(rows) <= set(before)
    for _, stage in p.STAGES:
        assert stage(spark, docs_of([None, "", "x y z"]).limit(0), sf_dir).count() == 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd):
    """Null, empty, repeated and very long texts, null ids and clashing columns: each stage gives its columns."""
    import corpus_pipeline as p

    rows = odd.unionByName(odd).withColumn("k1", F.lit("x")).withColumn("doc", F.lit("y"))
    for n, (name, stage) in enumerate(p.STAGES):
        given = rows if n == 0 else rows.select(p.COLUMNS)
        out = stage(spark, given, sf_dir)
        assert out.columns[:5] == p.COLUMNS and (n == 4 or len(out.columns) == 5), name
        kept = out.collect()
        assert {(r.doc_id, r.text) for r in kept} <= {(r.doc_id, r.text) for r in rows.collect()} or name == "lines", name


def test_language_sample_takes_a_text_once(spark, docs_of, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 40)
    texts = spark.createDataFrame([(f"text number {i} of many",) for i in range(200)], "text string")
    first = texts.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 40))).first().text
    docs = docs_of([r.text for r in texts.collect()] + [first] * 2000)
    got = langid.sample(docs, F.lit(True), "text", "lang").toPandas()
    assert len(got) == 40 and got["text"].nunique() == 40 and first in set(got["text"])
