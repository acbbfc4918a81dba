"""Personal data: base detectors plus information-theoretic sanitisation.

The base detectors find e-mail addresses, IP addresses, payment cards and phone numbers in whole texts. Every distinct
value is a *protected entity*, and so is a secret: a run of letters and digits mixed throughout that carries
``SECRET_BITS`` of information at least (its length times the entropy of its characters). Over the whole corpus it is
counted in how many documents a term stands, n(t), an entity stands, n(e), and both stand in one line with fewer than ``NEAR``
words between them, n(e, t): a line of any length gives each value so many terms at most. A term
discloses the entity as far as their pointwise mutual information reaches the entity's own information content:

    PMI(e; t) >= ALPHA * IC(e),   PMI = log(n(e,t) * N / (n(e) * n(t))),   IC(e) = log(N / n(e))

with at least ``MIN_SUPPORT`` joint documents. Such terms are spans of kind ``term`` wherever they stand in a document
that holds the entity, in its line or elsewhere; ``sanitise`` replaces base spans and secrets by their kind and terms by
a general placeholder (or removes them).

Corpus counts cover every document. Only terms that stand beside an entity need a count, so a bitmap of fixed size
(``2 ** BITMAP_POWER`` bits: a proven bound) tells the counting pass which word hashes may matter; the exact join follows.

Defined results: a null text is empty; spans belong to texts, so repeated rows, null ids and equal ids with different
texts each get those of their own text, and every row adds to the counts; overlapping base spans of different kinds all
stay; a value that stands in fewer than ``MIN_SUPPORT`` documents has no terms.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.llm.keys import only_keys, text_key
from millrace.llm.packed import spread
from millrace.session import arrow_map, materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans; the method adds the last two.
ALL_KINDS = (*KINDS, "term", "secret")
TERM, SECRET = len(KINDS), len(KINDS) + 1
SECRET_BITS, SECRET_TURNS = 64, 4
ALPHA = 0.9
MIN_SUPPORT = 2
#: Words on either side of a value, within its line, that stand beside it.
NEAR = 64
#: Parts that the texts holding one entity are dealt over, so that an entity of every document is no single key.
SALTS = 16
BITMAP_POWER = 24

# Fixed patterns of the base detectors. Each search is anchored where a match can begin, so no run is scanned twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])")
_TURN = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
_TERM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]{3,}")

Span = tuple[int, int, int]  # start, rank of the kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, 0, m.end()
            done = m.end()
        else:
            done = at + 1  # what stands before this sign cannot be part of a later address
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """All base spans of a text, by start and then by kind."""
    out = list(_emails(text)) if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret_spans(text: str, base: list[Span]) -> list[Span]:
    """Runs of mixed letters and digits that carry much information and lie in no base span."""
    out = []
    starts, ends = [a for a, *_ in base], list(accumulate((z for *_, z in base), max))
    for m in _RUN.finditer(text):
        run, before = m[0], bisect_left(starts, m.end())
        if len(_TURN.findall(run)) >= SECRET_TURNS and not (before and ends[before - 1] > m.start()):
            counts = np.unique(np.frombuffer(run.encode(), np.uint8), return_counts=True)[1]
            if -(counts * np.log2(counts / len(run))).sum() >= SECRET_BITS:
                out.append((m.start(), SECRET, m.end()))
    return out


def _words_outside(text: str, spans: list[Span], start: int, end: int) -> Iterator[re.Match]:
    """Words of a stretch of text that no span touches."""
    covered = np.zeros(end - start + 1, bool)
    for a, _, z in spans:
        if a < end and z > start:
            covered[max(0, a - start) : z - start] = True
    for m in _TERM.finditer(text, start, end):
        if not covered[m.start() - start : m.end() - start].any():
            yield m


def _near(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """(entity, term hash), each pair once, for the words of a span's line that stand within NEAR words of it."""
    line_of: dict[int, list[Span]] = {}
    for s in spans:
        line_of.setdefault(text.rfind("\n", 0, s[0]) + 1, []).append(s)
    words, starts, first, past, names = [], [], [], [], []
    for start, own in line_of.items():
        end = text.find("\n", start)
        lo = len(starts)
        for m in _words_outside(text, own, start, len(text) if end < 0 else end):
            words.append(m[0])
            starts.append(m.start())
        for a, k, z in own:
            at = bisect_left(starts, a, lo)
            first.append(max(lo, at - NEAR))
            past.append(min(len(starts), at + NEAR))
            names.append(_entity(ALL_KINDS[k], text[a:z]))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array(past) - np.array(first)
    entity = np.repeat(np.array(names, np.int64), sizes)
    term = tv.hash_words(words, table=tv.ALNUM).view(np.int64)[spread(np.array(first), sizes)]
    order = np.lexsort((term, entity))
    entity, term = entity[order], term[order]
    new = np.concatenate([[True], (entity[1:] != entity[:-1]) | (term[1:] != term[:-1])]) if len(order) else np.zeros(0, bool)
    return entity[new], term[new]


SPANS = "array<struct<start:long,kind:int,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def _struct(spans: list[Span]) -> list[dict]:
    return [{"start": s, "kind": k, "end": e} for s, k, e in spans]


def _pair_lists(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    entity, term = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    off = np.cumsum([0, *(len(e) for e, _ in pairs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(entity), pa.array(term)], names=["entity", "term"]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, k1, k2, base, secrets, entities, near``: key of the text, its spans, the entities they name, and the words that
    stand in a line with one, as (entity, term hash)."""
    base = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).alias("t"))
    kind = base.schema["id"].dataType.simpleString()
    def run(batches):
        for batch in batches:
            all_base, secrets, entities, pairs = [], [], [], []
            for t in batch.column(3):
                text = t.as_py() or ""
                spans = base_spans(text)
                hidden = secret_spans(text, spans)
                all_base.append(_struct(spans))
                secrets.append(_struct(hidden))
                own = [*spans, *hidden]
                entities.append(sorted({_entity(ALL_KINDS[k], text[a:z]) for a, k, z in own}))
                pairs.append(_near(text, own))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(all_base, _SPANS), pa.array(secrets, _SPANS), pa.array(entities, pa.list_(pa.int64())), _pair_lists(pairs)],
                names=["id", "k1", "k2", "base", "secrets", "entities", "near"],
            )

    return arrow_map(base, run, f"id {kind}, k1 long, k2 long, base {SPANS}, secrets {SPANS}, entities array<long>, near array<struct<entity:long,term:long>>")


def _entity(kind: str, value: str) -> int:
    """A protected value under a 64-bit name, so that intermediate tables do not hold it in clear."""
    return int.from_bytes(hashlib.blake2b(f"{kind}={value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _candidate_bitmap(pairs: DataFrame) -> np.ndarray:
    """Presence by the top bits of candidate terms' hashes: BITMAP_BITS / 8 bytes whatever the corpus."""
    slot = F.shiftrightunsigned("term", 64 - BITMAP_POWER)
    parts = (
        pairs.select(slot.alias("s"))
        .groupBy(F.expr("s div 32768").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(s % 32768)").alias("bits"))
        .collect()  # at most 2 ** BITMAP_POWER / 32768 rows of 4 KB
    )
    out = np.zeros((1 << BITMAP_POWER) // 8, np.uint8)
    for r in parts:
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _document_counts(docs: DataFrame, text_col: str, bits: np.ndarray) -> DataFrame:
    """``term, n_t``: in how many documents each word that the bitmap admits stands."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # fixed size

    def run(batches):
        on = np.unpackbits(shared.value, bitorder="little").view(bool)
        for batch in batches:
            terms, counts = [], []
            for _, _, b, off in tv.chunks(batch.column(0)):
                h, _, _, woff = tv.words(b, off, tv.ALNUM)
                keep = np.flatnonzero(on[(h >> np.uint64(64 - BITMAP_POWER)).astype(np.int64)])
                if not len(keep):
                    continue
                row = np.searchsorted(woff, keep, "right")
                order = np.lexsort((row, h[keep]))
                hs, rs = h[keep][order], row[order]
                first = np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])
                keys, n = np.unique(hs[first], return_counts=True)
                terms.append(keys)
                counts.append(n)
            if terms:
                keys, at = np.unique(np.concatenate(terms), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["term", "n"])

    parts = arrow_map(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")), run, "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``entity, term``: pairs whose mutual information reaches the disclosure threshold. ``found`` is what ``detect`` gives."""
    joint = found.select(F.explode("near").alias("x")).select("x.entity", "x.term")  # distinct in a document
    pairs = joint.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= min_support)
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    total = found.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    # PMI >= alpha * IC bounds n(t) from above. The documents seen so far bound it from below, which rules out common
    # words before the corpus is counted, and loses no term.
    seen = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term"))
    seen = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n_c"))
    most = F.col("n_et") * F.pow(F.col("n") / F.col("n_e"), 1 - alpha)
    pairs = pairs.join(entities, "entity").join(seen, "term").crossJoin(F.broadcast(total)).filter(F.col("n_c") <= most * (1 + 1e-9))
    pairs, _ = materialise(pairs.drop("n_c"), "pairs")
    terms = _document_counts(docs, text_col, _candidate_bitmap(pairs))
    scored = pairs.join(terms, "term")
    pmi = F.log(F.col("n_et") * F.col("n") / (F.col("n_e").cast("double") * F.col("n_t")))
    ic = F.log(F.col("n") / F.col("n_e"))
    return scored.filter(pmi >= alpha * ic).select("entity", "term")


def _texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``wanted`` (k1, k2 and more) with the text of each key; copies of a text meet before the exchange."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(*text_key(F.col(text_col)), F.col(text_col).alias("t"))
    return only_keys(texts, F.col("k1"), wanted, "k1").groupBy("k1", "k2").agg(F.min("t").alias("t")).join(wanted, ["k1", "k2"])


def _term_spans(marked: DataFrame) -> DataFrame:
    """``k1, k2, more``: where the terms of a text stand in it, outside the spans that name entities."""

    def run(batches):
        for batch in batches:
            more = []
            for t, terms in zip(batch.column(2), batch.column(3), strict=True):
                text, wanted = t.as_py(), np.array(terms.as_py(), np.int64)
                base = base_spans(text)
                words = list(_words_outside(text, [*base, *secret_spans(text, base)], 0, len(text)))
                hashes = tv.hash_words([m[0] for m in words], table=tv.ALNUM).view(np.int64) if words else np.zeros(0, np.int64)
                more.append(_struct([(words[i].start(), TERM, words[i].end()) for i in np.flatnonzero(np.isin(hashes, wanted)).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, _SPANS)], names=["k1", "k2", "more"])

    return arrow_map(marked.select("k1", "k2", "t", "terms"), run, f"k1 long, k2 long, more {SPANS}")


def keyed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``id, k1, k2, base, spans`` of every row."""
    found, _ = materialise(detect(docs, id_col, text_col), "spans")
    risky = disclosing_terms(docs, found, text_col, alpha, min_support)
    held = found.select("k1", "k2", F.explode("entities").alias("entity")).distinct().withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    risky = risky.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = held.join(risky, ["entity", "salt"])
    marks, _ = materialise(held.groupBy("k1", "k2").agg(F.collect_set("term").alias("terms")), "marks")
    out = found.join(_term_spans(_texts_of(docs, marks, text_col)), ["k1", "k2"], "left")
    more = F.coalesce("more", F.array().cast(SPANS.replace("long", "bigint")))
    return out.select("id", "k1", "k2", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "secrets", more)).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``<id>, base, spans``: base spans and all spans of every row, as (start, kind, end); kinds are places in ALL_KINDS."""
    return keyed_spans(docs, id_col, text_col, alpha, min_support).select(F.col("id").alias(id_col), "base", "spans")


def _joined(spans: str):
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(docs: DataFrame, remove_terms: bool = False, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with every base span and secret replaced by its kind and every disclosing term generalised or removed. A text
    and its spans meet by the text's key, so ids play no part."""
    spans = keyed_spans(docs, id_col, text_col, **kw).filter(F.size("spans") > 0).groupBy("k1", "k2").agg(F.min("spans").alias("spans"))
    spans, _ = materialise(spans, "masks")
    names = [f"[{k.upper()}]" for k in ALL_KINDS]
    names[TERM] = "" if remove_terms else "[TERM]"

    def run(batches):
        for batch in batches:
            texts = []
            for t, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pieces, done = [], 0
                for s in found:
                    if s["start"] >= done:  # what lies within a replaced span is gone already
                        pieces += [t[done : s["start"]], names[s["kind"]]]
                    done = max(done, s["end"])
                texts.append("".join([*pieces, t[done:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k1", "k2", "clean"])

    masked = arrow_map(_texts_of(docs, spans, text_col).select("k1", "k2", "t", "spans"), run, "k1 long, k2 long, clean string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *text_key(F.col(text_col)))
    field = F.col("doc").getField
    text = F.coalesce("clean", field(text_col))
    return rows.join(masked, ["k1", "k2"], "left").select(*[(text if c == text_col else field(c)).alias(c) for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{ALL_KINDS[k]}")
    return out.select(
        "doc_id", *(count(k) for k in range(4)), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
        count(TERM), count(SECRET), F.size("spans").cast("long").alias("n_spans"),
    )
