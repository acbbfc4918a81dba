"""Language-model scores, tokenizer alignment and ranked search: against brute force, numerical gradients, odd rows."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, lexical, lm, packed, pii
from millrace.llm import recurrent as rn

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- language model ---


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check_counts(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, below = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted((str(i), held(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.5) / below) for x in w), 4)) for i, t in rows)
    out = lm.op11(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    return out


def test_base_scores_against_brute_force(spark, sf_dir):
    check_counts(table(spark, sf_dir, "documents"))


def test_scores_of_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 5)
    monkeypatch.setattr(lm, "COUNTED", 4)
    check_counts(odd)
    assert lm.op11(odd.limit(0)).count() == 0
    none = lm.op11(odd.filter("doc_id = 4")).first() if held(4) else lm.score(odd, F.lit(False)).first()
    assert none.train_tokens == 0 and none.n_known == 0


def test_slots_of_a_bucket_agree(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SLOT_BYTES", 500)
    check_counts(table(spark, sf_dir, "documents"))


def test_held_out_texts_are_likelier_than_by_counts(spark):
    out = lm.op11(table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b


def _network(n=30, n_classes=5):
    net = rn.fresh(np.arange(n, 0, -1).astype(float), n_classes, units=6)
    for p in ("oc", "ow"):
        getattr(net, p)[:] = np.random.default_rng(2).standard_normal(getattr(net, p).shape) * 0.3
    return net


def test_probabilities_sum_to_one_and_documents_do_not_mix():
    net, rng = _network(), np.random.default_rng(0)
    state = rng.standard_normal((4, 6)).astype(np.float32).clip(-1, 1)
    each = np.stack([np.exp(rn.log_probabilities(net, state, np.full(4, k))) for k in range(30)])
    assert np.allclose(each.sum(axis=0), 1, atol=1e-5)
    docs = [rng.integers(0, 29, n) for n in (0, 1, 3, 200, 7, 64, 500, 0, 33)]
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    alone = [rn.score(net, d, np.array([0, len(d)]), 29)[0] for d in docs]
    for lanes in (1, 3, 256):
        assert np.allclose(rn.score(net, np.concatenate(docs), off, 29, lanes), alone, rtol=1e-5)


def test_windows_carry_the_state(monkeypatch):
    net, doc = _network(), np.random.default_rng(1).integers(0, 29, 300)
    whole = rn.score(net, doc, np.array([0, 300]), 29)
    state, total = np.zeros((1, 6), np.float32), 0.0
    for t, (before, said) in enumerate(zip([29, *doc], [*doc, 29], strict=True)):  # one step after another
        gates = 1 / (1 + np.exp(-(net.x[before, :12] + state @ net.u)))
        new = np.tanh(net.x[before, 12:] + (gates[:, 6:] * state) @ net.ug)
        state = (state + gates[:, :6] * (new - state)).astype(np.float32)
        logits = state @ net.oc.T + net.bc
        c = int(np.searchsorted(net.edges, said, "right") - 1)
        own = state @ net.ow[net.edges[c] : net.edges[c + 1]].T + net.bw[net.edges[c] : net.edges[c + 1]]
        total += logits[0, c] - np.log(np.exp(logits).sum()) + own[0, said - net.edges[c]] - np.log(np.exp(own).sum())
    assert np.isclose(whole[0], total, rtol=1e-4)


@pytest.mark.parametrize("name", ["x", "u", "ug", "oc", "bc", "ow", "bw"])
def test_backpropagation_against_differences(monkeypatch, name):
    """The gradient of a first step, read off a step of plain descent, against numerical differences."""
    docs, off = np.random.default_rng(3).integers(0, 29, 40), np.array([0, 12, 40])
    monkeypatch.setattr(rn, "STEPS", 64)
    seen = {}
    monkeypatch.setattr(rn, "_step", lambda net, p, grad, rows=slice(None): seen.setdefault(p, []).append((rows, grad)))
    net = _network()
    rn.train(net, docs, off, 29)
    grad = np.zeros(getattr(net, name).shape)
    for rows, g in seen[name]:
        grad[rows] += g * 32
    own, rng = getattr(net, name), np.random.default_rng(4)
    flat = own.reshape(-1)
    picks = rng.choice(np.flatnonzero(np.abs(grad).reshape(-1) > 1e-3), 6)
    for i in picks:
        old, loss = flat[i], []
        for step in (0.02, -0.02):
            flat[i] = old + step
            loss.append(-rn.score(net, docs, off, 29).sum())
        flat[i] = old
        assert np.isclose((loss[0] - loss[1]) / 0.04, grad.reshape(-1)[i], rtol=0.06, atol=0.02)


def test_packed_arrays():
    for arrays in ([np.zeros(0, np.int64)], [np.arange(5), np.array([1 << 60, 0, 3, 70000, 255])]):
        assert all((a == b).all() for a, b in zip(packed.unpack(packed.pack(*arrays)), arrays, strict=True))


# --- tokenizer alignment ---

PIECES = [
    "  two  blanks\n\nlines \t tab", "holds ▁ that", "<s>plain</s> <|endoftext|> <0x41>", "日本語 のテキスト  x", " nb sp\x1c x \x85 y", " lead", "trail ",
    "ab cd " * 50, "🙂🙃 é́ \x00 z", "don't can't 's  's", "x" * 3000, "=== ----- 12345 6789", " ", "\n", "a　b  c",
]


def aligned_brute(rows):
    both = alignment.Aligner(*alignment.tokenizer_files())
    found, docs = {}, collections.Counter()
    for n, (_, text) in enumerate(rows):
        spelt = (" " + (text or "")).encode()
        a, b = (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        if not text or b"".join(both.bytes_a[i] for i in a) != spelt or b"".join(both.bytes_b[i] for i in b) != spelt:
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((both.bytes_a, a), (both.bytes_b, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[next(k for k, c in enumerate(cuts) if e <= c)][side].append(i)
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        found[n] = (len(a), len(b), groups, links)
        docs.update(links.keys())
    best = collections.Counter()
    for (x, _), c in docs.items():
        best[x] = max(best[x], c)
    out = []
    for n, (i, _) in enumerate(rows):
        if n not in found:
            out.append((str(i), 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = found[n]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sums = sum(m for (x, y), m in links.items() if docs[x, y] == best[x]), sum(m * docs[p] for p, m in links.items())
        out.append((str(i), na, nb, len(groups), sum(links.values()), *sums, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out)


def aligned(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.op12(df).collect())


def test_alignment_against_brute_force(spark, sf_dir, docs_of):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    rows = [*rows[:80], *((10**6 + i, t) for i, t in enumerate(PIECES))]
    assert aligned(docs_of(rows)) == aligned_brute(rows)


def test_alignment_in_small_slices_and_slots(spark, docs_of, monkeypatch):
    rows = [(i % 7, t) for i, t in enumerate([*PIECES, *PIECES, "the the", None, ""] * 2)] + [(None, "the end")]
    want = aligned_brute(rows)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 60)
    monkeypatch.setattr(alignment, "SLOT_BYTES", 40)
    assert aligned(docs_of(rows)) == want
    assert alignment.op12(docs_of(rows).limit(0)).count() == 0


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 3)
    both = alignment.Aligner(*alignment.tokenizer_files())
    texts = ["one two three four", "five six two", "one seven"]
    parts = [alignment._aligned(both, [t])[:2] for t in texts]
    whole = alignment._aligned(alignment.Aligner(*alignment.tokenizer_files()), texts)
    assert [p[1][0] for p in parts] == whole[1] and (np.concatenate([p[0] for p in parts]) == whole[0]).all()


# --- ranked search ---


def ranked_brute(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UP))
    own = [(i, collections.Counter(cut(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(w for _, c in own for w in c)
    asked = collections.defaultdict(set)
    for q, t in items:
        asked[q] |= set(cut(t))
    out = []
    for q, terms in asked.items():
        scores = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_against_brute_force(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = ranked_brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 50)
    assert ranked(lexical.op13(docs, bench)) == want


def test_search_of_odd_rows_in_blocks(spark, docs_of, odd, monkeypatch):
    items = [(0, "tie one TWO"), (1, None), (2, ""), (3, "word"), (3, "same id"), (4, "nowhere to be found"), (5, "é É row")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = ranked_brute(rows, items, 50)
    assert ranked(lexical.op13(odd, bench)) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4)
    monkeypatch.setattr(lexical, "INDEX_POSTINGS", 3)
    assert ranked(lexical.op13(odd, bench)) == want
    assert lexical.op13(odd.limit(0), bench).count() == 0 and lexical.op13(odd, bench.limit(0)).count() == 0


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(5)
    n, terms = 20_000, 12
    held = [np.flatnonzero(rng.random(n) < 0.6 / (1 + t) ** 2 + 0.0005) for t in range(terms)]
    length = rng.integers(50, 500, n)
    term = np.concatenate([np.full(len(h), t) for t, h in enumerate(held)])
    doc, tf = np.concatenate(held), rng.integers(1, 6, len(term))
    w = lexical.weights(n, np.bincount(term, minlength=terms))
    import pyarrow as pa

    slices = [(pa.array(range(n)), packed.pack(length), packed.pack(*np.unique(term, return_counts=True)), packed.pack(doc, tf))]
    index = lexical.Index(slices, w, n, int(length.sum()))
    exact = np.bincount(doc, w[term] * lexical.impacts(tf, length[doc], n, int(length.sum())), n).astype(np.int64)
    for k in (1, 10, 50):
        index.taken = 0
        some, score = index.search(np.arange(terms), k)
        kth = np.sort(exact)[-k]
        assert set(some.tolist()) >= set(np.flatnonzero(exact >= kth).tolist()) and (exact[some] == score).all()
        assert index.taken < 0.6 * len(term)


# --- personal data in a very long line ---


def test_many_values_in_one_long_line():
    words = [f"a{i}@example{i % 7}.org" if i % 20 == 0 else f"w{i}" for i in range(100_000)]
    text = " ".join(words)
    tracemalloc.start()
    spans = pii.base_spans(text)
    spans += pii.secret_spans(text, spans)
    entity, term = pii._near(text, spans)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == 5000 and len(entity) <= 2 * pii.NEAR * 5000 and peak < 500e6
    assert len(set(zip(entity.tolist(), term.tolist(), strict=True))) == len(entity)
