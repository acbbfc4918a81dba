"""The language model learns from every training document."""

import numpy as np

from millrace.llm import lm
from millrace.llm import recurrent as rn


def test_all_training_documents_are_learnt_from(spark, monkeypatch):
    texts = spark.createDataFrame([(f"a{i} b c",) for i in range(200)], "t string")
    words = lm.vocabulary(lm.word_counts(texts), 200)
    taken = []
    net = rn.fresh(words.mass(), lm.CLASSES)
    flat = net.flat()
    real = lm.arrow_map

    def spied(df, fn, schema):
        if df.columns == ["t"]:
            taken.append(df.count())
        return real(df, fn, schema)

    monkeypatch.setattr(lm, "arrow_map", spied)
    trained = lm.train(texts, words)
    assert sum(taken) == 200 and len(taken) == lm.ROUNDS  # it was a sixth
    assert (trained.flat() != flat).any()


def test_a_class_and_the_tokens_within_it_are_few_together():
    counts = np.concatenate([[0.9], 1 / np.arange(1, 2048)]) * 1e6  # half of all tokens are of one number, the others by Zipf's law
    edges = rn.classes(counts, lm.CLASSES)
    sizes = np.diff(edges)
    mean = len(sizes) + (np.add.reduceat(counts, edges[:-1]) * sizes).sum() / counts.sum()
    assert edges[0] == 0 and edges[-1] == 2048 and (sizes > 0).all()
    assert mean < 70  # it was 91


def test_probabilities_of_far_logits():
    net = rn.fresh(np.arange(40.0, 0, -1), 4, units=6)
    net.ow[:], net.bw[:] = 8 * np.random.default_rng(1).standard_normal(net.ow.shape), np.linspace(-30, 30, 40)
    states = np.random.default_rng(2).uniform(-1, 1, (50, 6)).astype(np.float32)
    each = np.stack([np.exp(rn.log_probabilities(net, states, np.full(50, k))) for k in range(40)])
    assert np.allclose(each.sum(axis=0), 1, atol=1e-4)
    assert len(rn.log_probabilities(net, states[:0], np.zeros(0, np.int64))) == 0
