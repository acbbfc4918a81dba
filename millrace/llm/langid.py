"""Language identification by hierarchical discrimination.

First a linear model over hashed byte n-grams predicts the language *family*; then one-versus-one linear support
vector machines, trained only within that family, separate its closely related languages by vote (ties by margin).
Both levels are trained here, with averaged stochastic sub-gradient descent on the hinge loss.

Training uses a bounded sample of the labelled rows: ``SAMPLE_ROWS`` whole texts shared evenly by all languages, but no
fewer than ``LEAST_EACH`` a language, those with the smallest hash of text. The bound is documented and follows the number
of languages, never the corpus; no label is left out. The fit runs in one executor task, and only the model comes to the
driver. Prediction covers every row and the whole text: n-gram weights are gathered and summed per row in numpy, on
Arrow batches.

Defined results: null text or one without a letter gives ``und`` with score 0; equal texts get equal answers, whatever
their id, source or label; with no labelled row everything is ``und``; with a single language every text with letters
is that language. Very long texts are scored in full.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textvec as tv
from millrace.session import arrow_map

SAMPLE_ROWS, LEAST_EACH = 3000, 8
BITS = 13
BUCKETS = 1 << BITS
EPOCHS = 4

#: Families of common languages (ISO 639-1). Fixed values; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indic": "hi bn mr ne gu pa ur",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "semitic": "ar he am mt",
}


def family_of(lang: str) -> str:
    base = lang.split("-")[0].lower()
    return next((f for f, members in FAMILIES.items() if base in members.split()), f"={lang}")


def _grams(b: np.ndarray) -> np.ndarray:
    """Buckets of all 1- to 4-grams of the folded bytes of one text."""
    n = len(b)
    x = b.astype(np.uint32)
    h = np.zeros(n, np.uint32)
    out = []
    for k in range(min(4, n)):
        h = h[: n - k] * np.uint32(0x01000193) ^ (x[k:] + np.uint32(k * 257 + 1))
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((g >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None  # family columns first, then the pairs of each family
    bias: np.ndarray | None = None
    pairs: list[tuple[str, str, str]] = field(default_factory=list)


class _Features:
    """Square roots of relative n-gram frequencies of whole texts, kept sparse; ``rows`` fills in some of them."""

    def __init__(self, texts: list[str]):
        self.at, self.values = [], []
        for _, _, b, off in tv.chunks(pa.array(texts, pa.large_string())):
            for i in range(len(off) - 1):
                g = _grams(_FOLD[b[off[i] : off[i + 1]]])
                counts = np.bincount(g, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                self.at.append(at.astype(np.int32))
                self.values.append(np.sqrt(counts[at] / max(1, len(g))).astype(np.float32))

    def rows(self, which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for r, i in enumerate(which.tolist()):
            x[r, self.at[i]] = self.values[i]
        return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in [*range(0, 65), *range(91, 97), *range(123, 128)]:
    _FOLD[_c] = 32  # digits, punctuation and marks say nothing about the language


def _svm(x: _Features, own: np.ndarray, y: np.ndarray, seed: int = 7, lam: float = 1e-4) -> tuple[np.ndarray, float]:
    """Averaged Pegasos on hinge loss over the rows ``own``, classes balanced by weight; y in {-1, 1}."""
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, c, aw, ac, t = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0, 0
    size = 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), size):
            t += 1
            k = order[i : i + size]
            some = x.rows(own[k])
            rate = 1.0 / (lam * (t + 100))
            bad = y[k] * (some @ w + c) < 1
            g = (y[k] * weight[k] * bad) / len(k)
            w = (1 - rate * lam) * w + rate * (g @ some)
            c += rate * 0.01 * g.sum()
            aw += w
            ac += c
    return aw / max(1, t), ac / max(1, t)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Fit on texts and their languages; bounded by the caller."""
    names = sorted(set(langs))
    model = Model()
    if not names:
        return model
    x = _Features(texts)
    lang = np.array(langs, object)
    every = np.arange(len(lang))
    fam = np.array([family_of(v) for v in langs], object)
    model.families = sorted(set(fam))
    model.languages = {f: [v for v in names if family_of(v) == f] for f in model.families}
    cols = [_svm(x, every, np.where(fam == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else [(np.zeros(BUCKETS), 1.0)]
    for f in model.families:
        for a, b in combinations(model.languages[f], 2):
            pick = np.flatnonzero((lang == a) | (lang == b))
            cols.append(_svm(x, pick, np.where(lang[pick] == a, 1.0, -1.0)))
            model.pairs.append((f, a, b))
    model.weights = np.stack([w for w, _ in cols], 1).astype(np.float32)
    model.bias = np.array([c for _, c in cols])
    return model


def learn(rows: DataFrame) -> Model:
    """The model of ``text, lang`` rows whose number the caller bounds, fitted in one executor task: the driver gets the
    model alone, of ``BUCKETS`` floats for each family and pair."""

    def run(batches):
        found = sorted((lang, t) for batch in batches for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if found:
            model = fit([t for _, t in found], [lang for lang, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = arrow_map(rows.select("text", "lang").repartition(1), run, "model binary").collect()  # one row at most
    return pickle.loads(bytes(made[0]["model"])) if made else Model()


def margins(model: Model, b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Margin of every column of the model for each row: sqrt of relative frequencies times weights."""
    out = np.zeros((len(off) - 1, model.weights.shape[1]))
    b = _FOLD[b]
    for i in range(len(out)):
        g = _grams(b[off[i] : off[i + 1]])
        if len(g):
            counts = np.bincount(g, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            out[i] = np.sqrt(counts[at] / len(g)) @ model.weights[at]
    return out + model.bias


def decide(model: Model, m: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each row of margins."""
    k = len(model.families)
    fam = np.argmax(m[:, :k], 1)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(4 * z, -50, 50)))
    f_score = squash(m[:, :k])
    f_score = f_score / np.maximum(f_score.sum(1, keepdims=True), 1e-12)
    langs, scores = np.empty(len(m), object), np.zeros(len(m))
    for i, f in enumerate(model.families):
        at = np.flatnonzero(fam == i)
        if not len(at):
            continue
        names = model.languages[f]
        votes, conf = np.zeros((len(at), len(names))), np.ones((len(at), len(names)))
        for j, (g, a, b) in enumerate(model.pairs):
            if g == f:
                z = m[at, k + j]
                p = squash(z)
                ia, ib = names.index(a), names.index(b)
                votes[:, ia] += z > 0
                votes[:, ib] += z <= 0
                conf[:, ia] = np.minimum(conf[:, ia], p)
                conf[:, ib] = np.minimum(conf[:, ib], 1 - p)
        best = np.argmax(votes + 0.5 * conf, 1)
        langs[at] = np.array(names, object)[best]
        scores[at] = f_score[at, i] * conf[np.arange(len(at)), best]
    return list(langs), scores


def sample(docs: DataFrame, usable: Column, text_col: str, lang_col: str) -> DataFrame:
    """The bounded training sample ``text, lang``: distinct whole texts, SAMPLE_ROWS in all shared evenly by the languages
    and LEAST_EACH of each at least.

    Texts with the smallest hash are taken; copies count once. Only texts whose hash lies below a share that leaves about
    four times the bound are ranked, so no task ever sees a whole hot language.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("m")).collect()  # a row for each language
    if not sizes:
        return rows.select("text", "lang").limit(0)
    each = max(LEAST_EACH, SAMPLE_ROWS // len(sizes))
    below = {r["lang"]: int((1 << 40) * min(1.0, 4 * each / max(r["m"], 1))) for r in sizes}
    cut = F.create_map(*[F.lit(v) for kv in below.items() for v in kv])
    near = rows.filter(F.col("h") < cut[F.col("lang")]).distinct()  # copies of a text meet before the shuffle
    order = Window.partitionBy("lang").orderBy("h", "text")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each).select("text", "lang")


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score; no other column is looked at."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # BUCKETS x (families + pairs) floats: bounded by the languages, not by rows
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    base = docs.select(*keep)
    schema = T.StructType([*base.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            lettered = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(col), "und", object), np.zeros(len(col))
            if m.families:
                for a, z, b, off in tv.chunks(col):
                    langs[a:z], scores[a:z] = decide(m, margins(m, b, off))
            langs[~lettered], scores[~lettered] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(langs), pa.string()), pa.array(scores)], names=[*batch.schema.names, lang_out, score_out]
            )

    return arrow_map(base, run, schema)


def identify(
    docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang",
    lang_out: str = "lang_pred", score_out: str = "lang_score",
) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that ``usable`` admits, then predict every row."""
    model = learn(sample(docs, F.lit(True) if usable is None else usable, text_col, lang_col))
    return predict(docs, model, text_col, lang_out, score_out)


def op3(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = learn(sample(docs, ~held, "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model, lang_out="lang_pred", score_out="score")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
