"""Benchmark decontamination by spaced-seed hashing.

Words (letters, digits and non-ASCII characters, lower-cased) of benchmark items and of documents are hashed under a
few fixed masks that ignore some positions, so an overlap is found although single words in it were replaced. Hashes
of both sides are joined; each hit names an alignment (item and diagonal), and the alignment is verified on the words
themselves: a window of ``WINDOW`` item words (the whole item if shorter) of which ``MIN_MATCH`` agree.

A seed that more than ``HOT_ITEMS`` items hold, a phrase of a template say, would name an alignment for every document and item
that share it. It names windows instead: those of item and document that contain it are hashed under all masks that ignore as
many positions as a verified window may miss, so two windows have a hash in common exactly where they pass. Every window that
passes contains the seeds it has in common, so nothing is lost (a short window may pass without a common seed; it is found by
neither). Items that share a window hold it once, until the windows of a document are known.

Both sides are tables. The benchmark's seeds set the bits of a filter of fixed size (``2 ** FILTER_POWER`` bits), which
is all that every task gets; a document's seeds that pass it are joined with the seed table, by broadcast up to
``BROADCAST_SEEDS`` rows and by exchange beyond. Alignments of a document are distinct before they move, and each text
that has any goes once to the task that verifies them, one after another. Benchmark items of equal text, and documents
of equal text, are judged once; nothing is listed twice and nothing is left out.

Defined results: null or empty texts on either side match nothing; an item without words or with a null id matches
nothing; verdicts belong to texts, so repeated rows, null ids and equal ids with different texts each get that of their
own text; items of equal text all count; a document's matches keep every item id, in order; an empty table on either side
leaves every document clean; very long texts are hashed a slice of rows at a time; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.llm.keys import only_keys, text_key, without
from millrace.session import arrow_map, materialise

#: Fixed masks, '1' compares and '0' ignores a position.
MASKS = ("11111", "1101011", "11001011", "1010100111")
#: Verified window of item words and the agreeing share of it.
WINDOW, MIN_MATCH = 13, 0.8
#: Items with fewer words are too short to tell from chance; they only match as a whole and word for word.
SHORT = 8
#: Items beyond which a seed names windows, not alignments.
HOT_ITEMS = 8
FILTER_POWER = 26
#: Seeds (some 30 bytes each) up to which the table is broadcast.
BROADCAST_SEEDS = 1_000_000
_SLOTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _seeds(h: np.ndarray, woff: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position in the row) of a mask at every place where it fits."""
    span = len(mask)
    n = np.maximum(np.diff(woff) - span + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(first[-1]) - first[row]
    at = woff[row] + pos
    with np.errstate(over="ignore"):
        s = np.full(len(at), np.uint64(salt + 1) * np.uint64(0xE7037ED1A0B428DB))
        for j, bit in enumerate(mask):
            if bit == "1":
                s = (s ^ h[at + j]) * np.uint64(0x9FB21C651E98DF25)
                s ^= s >> np.uint64(29)
    return s, row, pos


def _words(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    low = pc.utf8_lower(col.fill_null(""))
    for a, z, b, off in tv.chunks(low):
        h, _, _, woff = tv.words(b, off, tv.ALNUM, lower=False)
        yield a, z, h, woff


def _short_mask(n: int) -> tuple[str, int]:
    return "1" * n, 100 + n


# --- the benchmark ------------------------------------------------------------------------------------------------


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(``item, n, w``: distinct texts under their smallest id, with their word hashes; ``item, item_id``: all ids)."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("t")).filter("t IS NOT NULL AND item_id IS NOT NULL")
    texts = rows.groupBy("t").agg(F.min("item_id").alias("item"))

    def run(batches):
        for batch in batches:
            n, w = [], []
            for a, z, h, woff in _words(batch.column(1)):
                for i in range(z - a):
                    n.append(int(woff[i + 1] - woff[i]))
                    w.append(h[woff[i] : woff[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.binary())], names=["item", "n", "w"])

    items, _ = materialise(arrow_map(texts.select("item", "t"), run, "item long, n long, w binary").filter("n > 0"), "items")
    same = rows.join(texts, "t").select("item", "item_id").distinct()
    return items, same


def _seed_table(items: DataFrame) -> DataFrame:
    """``s, item, at``: the seeds of all items; a short item has its whole run of words as its one seed."""

    def run(batches):
        for batch in batches:
            out = []
            for item, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.frombuffer(w, np.uint64)
                masks = [_short_mask(len(h))] if len(h) < SHORT else [(m, i) for i, m in enumerate(MASKS)]
                for mask, salt in masks:
                    s, _, pos = _seeds(h, np.array([0, len(h)]), mask, salt)
                    out.append((s, np.full(len(s), item), pos))
            if out:
                s, item, pos = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(item.astype(np.int64)), pa.array(pos.astype(np.int64))], names=["s", "item", "at"])

    return arrow_map(items, run, "s long, item long, at long")


def _slots(s: np.ndarray, i: int, power: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((s * _SLOTS[i]) >> np.uint64(64 - power)).astype(np.int64)


def _filter(seeds: DataFrame) -> np.ndarray:
    """Presence of the seeds' slots: 2 ** FILTER_POWER bits whatever the benchmark."""
    power = FILTER_POWER

    def run(batches):
        for batch in batches:
            s = batch.column(0).to_numpy().view(np.uint64)
            slot = np.unique(np.concatenate([_slots(s, i, power) for i in range(len(_SLOTS))]))
            yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])

    parts = arrow_map(seeds.select("s"), run, "slot long").groupBy(F.expr("slot div 32768").alias("bucket"))
    rows = parts.agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits")).collect()  # 2 ** FILTER_POWER / 32768 rows of 4 KB at most
    bits = np.zeros((1 << power) // 8, np.uint8)
    for r in rows:
        bits[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _window_hashes(h: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Of the windows at ``starts``: the hash of all words, then one for each choice of positions that may differ."""
    with np.errstate(over="ignore"):
        own = [tv.mix(h[starts + j] + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)) for j in range(size)]
        total = np.sum(own, axis=0, dtype=np.uint64) if len(starts) else np.zeros(0, np.uint64)
        yield tv.mix(total + np.uint64(size))
        for i, out in enumerate(combinations(range(size), size - _needed(size))):
            yield tv.mix(total - np.sum([own[j] for j in out], axis=0, dtype=np.uint64) + np.uint64(1000 * size + i + 1)) if len(starts) else total


def _needed(size: int) -> int:
    return math.ceil(MIN_MATCH * size)


def _windows_around(h: np.ndarray, woff: np.ndarray, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among all words) of the windows that contain a seed whose slots are set."""
    found = []
    for salt, mask in enumerate(MASKS):
        s, row, pos = _seeds(h, woff, mask, salt)
        hit = _passing(bits, s)
        for back in range(size - len(mask) + 1):
            t = pos[hit] - back
            ok = (t >= 0) & (t + size <= np.diff(woff)[row[hit]])
            found.append(np.stack([row[hit][ok], woff[row[hit][ok]] + t[ok]]))
    row, at = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return row, at


def _item_windows(items: DataFrame, bits: np.ndarray) -> DataFrame:
    """``window, size, w, item, at``: the windows of items around hot seeds, named by the hash of their words."""
    shared = items.sparkSession.sparkContext.broadcast(bits)  # fixed size

    def run(batches):
        for batch in batches:
            out = []
            for item, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.frombuffer(w, np.uint64)
                size = min(WINDOW, len(h))
                if size >= SHORT:
                    _, at = _windows_around(h, np.array([0, len(h)]), shared.value, size)
                    names = next(_window_hashes(h, at, size)).view(np.int64).tolist()
                    out += [(name, size, h[t : t + size].tobytes(), item, t) for name, t in zip(names, at.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _WINDOW_TYPES, strict=True)], names=_WINDOW_NAMES)

    return materialise(arrow_map(items, run, "window long, size int, w binary, item long, at long"), "windows")[0]


_WINDOW_NAMES = ["window", "size", "w", "item", "at"]
_WINDOW_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def _window_keys(windows: DataFrame) -> DataFrame:
    """``s, window``: the hashes of each distinct window under the masks of its size."""

    def run(batches):
        for batch in batches:
            sizes, names = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                h = np.frombuffer(b"".join(batch.column(2).take(pa.array(own)).to_pylist()), np.uint64)
                keys = list(_window_hashes(h, np.arange(len(own)) * size, size))[1:]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(names[own], len(keys)))], names=["s", "window"])

    distinct = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("w").alias("w"))
    return materialise(arrow_map(distinct, run, "s long, window long"), "window-keys")[0]


# --- the documents ------------------------------------------------------------------------------------------------


def _passing(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    at, power = np.arange(len(s)), len(bits).bit_length() + 2
    for i in range(len(_SLOTS)):
        slot = _slots(s[at], i, power)
        at = at[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
    return at


def _hits(texts: DataFrame, cold: np.ndarray, hot: np.ndarray | None, keys: np.ndarray | None, lengths: list[int], sizes: list[int]) -> DataFrame:
    """``k1, k2, s, pos, hot``: the seeds of ``k1, k2, t`` that pass the filter, and the hashes of windows around hot seeds
    that do. A seed that is a whole short item counts once."""
    shared = texts.sparkSession.sparkContext.broadcast((cold, hot, keys))  # fixed size

    def found(h, woff):
        cold, hot, keys = shared.value
        for mask, salt in [(m, i) for i, m in enumerate(MASKS)] + [_short_mask(n) for n in lengths]:
            s, row, pos = _seeds(h, woff, mask, salt)
            at = _passing(cold, s)
            if salt >= 100 and len(at):
                _, first = np.unique(np.stack([row[at], s[at].view(np.int64)]), axis=1, return_index=True)
                at = at[first]
            yield row[at], s[at], pos[at], False
        for size in sizes:
            row, place = _windows_around(h, woff, hot, size)
            hashes = _window_hashes(h, place, size)
            next(hashes)
            for s in hashes:
                at = _passing(keys, s)
                yield row[at], s[at], place[at] - woff[row[at]], True

    def run(batches):
        for batch in batches:
            for a, _, h, woff in _words(batch.column(2)):
                for row, s, pos, is_hot in found(h, woff):
                    if len(row):
                        of = pa.array(row + a)
                        columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(s.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array(np.full(len(row), is_hot))]
                        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "s", "pos", "hot"])

    return materialise(arrow_map(texts, run, "k1 long, k2 long, s long, pos long, hot boolean"), "hits")[0]


def _alignments(texts: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """``k1, k2, item, diagonal``: what has to be verified, each once."""
    seeds = _seed_table(items)
    seeds = seeds.join(seeds.groupBy("s").agg((F.count(F.lit(1)) > HOT_ITEMS).alias("hot")), "s")
    seeds, _ = materialise(seeds, "seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    sized = F.broadcast if few else (lambda x: x)
    hot, keys, sizes, windows = None, None, [], None
    if not seeds.filter("hot").isEmpty():
        hot = _filter(seeds.filter("hot"))
        windows = _item_windows(items, hot)
        names = _window_keys(windows)
        keys = _filter(names)
        sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW rows at most
    hits = _hits(texts, _filter(seeds.filter("NOT hot")), hot, keys, lengths, sizes)
    cold = hits.filter("NOT hot").drop("hot").join(sized(seeds.filter("NOT hot").select("s", "item", "at")), "s")
    out = cold.select("k1", "k2", "item", (F.col("pos") - F.col("at")).alias("diagonal"))
    if windows is not None:
        sized = F.broadcast if names.count() <= BROADCAST_SEEDS else (lambda x: x)
        near = hits.filter("hot").join(sized(names), "s").select("k1", "k2", "pos", "window").distinct()
        near = near.join(sized(windows.select("window", "item", "at")), "window")
        out = out.unionByName(near.select("k1", "k2", "item", (F.col("pos") - F.col("at")).alias("diagonal")))
    return materialise(out.distinct(), "alignments")[0]


def _verify(item: np.ndarray, h: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Best window on an alignment: (covered item words, agreeing words, item words), or None below the threshold.

    ``diagonal`` is the document position at which the item's first word would stand; a short item agrees as a whole.
    """
    n = len(item)
    a, z = max(0, -diagonal), min(n, len(h) - diagonal)
    w = min(WINDOW, n)
    if z - a < w:
        return None
    same = (item[a:z] == h[diagonal + a : diagonal + z]).astype(np.int32)
    if n < SHORT:
        return (n, n, n) if same.all() else None
    sums = np.convolve(same, np.ones(w, np.int32), "valid")
    good = sums >= np.ceil(MIN_MATCH * w)
    if not good.any():
        return None
    mask = np.convolve(good, np.ones(w, np.int32)) > 0  # every word of a good window
    return int(mask.sum()), int(same[mask].sum()), n


def _verified(stream: DataFrame) -> DataFrame:
    """``k1, k2, item, words, matched, item_words, at`` from rows sorted by key: a text, then its alignments."""

    def run(batches):
        key, words, best = None, None, {}

        def flush(out):
            for item, (covered, same, at, n) in best.items():
                out.append((*key, item, covered, same, n, -at))
            best.clear()

        for batch in batches:
            out, own = [], {}
            texts = batch.column(3)
            for a, z, h, woff in _words(texts):
                own.update({a + i: h[woff[i] : woff[i + 1]] for i in range(z - a) if texts[a + i].is_valid})
            k1, k2, item, diagonal = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
            for i in range(len(batch)):
                if (k1[i], k2[i]) != key:
                    flush(out)
                    key, words = (k1[i], k2[i]), None
                if i in own:
                    words = own[i].copy()
                elif words is not None:
                    got = _verify(np.frombuffer(batch.column(6)[i].as_py(), np.uint64), words, diagonal[i])
                    if got:
                        new = (got[0], got[1], -max(0, diagonal[i]), got[2])
                        best[item[i]] = max(best.get(item[i], new), new)
            if out:
                yield _table(out)
        out = []
        flush(out)
        if out:
            yield _table(out)

    def _table(rows):
        names = ["k1", "k2", "item", "words", "matched", "item_words", "at"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return arrow_map(stream, run, "k1 long, k2 long, item long, words long, matched long, item_words long, at long")


def overlapping_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``k1, k2, item_id, words, matched, item_words, at``: verified overlaps, one row for each distinct text and item."""
    items, same = _items(benchmark, item_col, item_text)
    lengths = sorted(r["n"] for r in items.filter(F.col("n") < SHORT).select("n").distinct().collect())  # SHORT rows at most
    sized = F.broadcast if items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= BROADCAST_SEEDS else (lambda x: x)
    texts = docs.filter(F.col(text_col).isNotNull()).select(*text_key(F.col(text_col)), F.col(text_col).alias("t"))
    pairs = _alignments(texts, items, lengths)
    # Copies of a text meet before the exchange, and texts without an alignment stay out of it.
    wanted = only_keys(texts, F.col("k1"), pairs, "k1").groupBy("k1", "k2").agg(F.min("t").alias("t"))
    wanted = wanted.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    nothing = lambda kind: F.lit(None).cast(kind)
    first = wanted.select("k1", "k2", F.lit(0).alias("kind"), "t", nothing("long").alias("item"), nothing("long").alias("diagonal"), nothing("binary").alias("w"))
    then = pairs.join(sized(items.select("item", "w")), "item").select("k1", "k2", F.lit(1).alias("kind"), nothing("string").alias("t"), "item", "diagonal", "w")
    stream = first.unionByName(then).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "kind", "item", "diagonal")
    return _verified(stream).join(sized(same), "item").drop("item").select("k1", "k2", "item_id", "words", "matched", "item_words", "at")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``<id>, item_id, words, matched, item_words, at``: verified overlaps, one row per document row and item.

    ``words`` item words stand in verified windows, ``matched`` of them agree, ``at`` is the first document word.
    """
    found = overlapping_texts(docs, benchmark, text_col, item_col, item_text)
    rows = docs.select(F.col(id_col), *text_key(F.col(text_col)))
    return rows.join(found, ["k1", "k2"]).select(id_col, "item_id", "words", "matched", "item_words", "at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; every row is judged by its text alone."""
    bad = overlapping_texts(docs, benchmark, text_col, **kw).select("k1", "k2").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *text_key(F.col(text_col)))
    bad, _ = materialise(bad, "found")
    return without(rows, ["k1", "k2"], bad).select("doc.*")


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with its verified items: doc_id, contaminated, n_items, item_ids, max_words, max_matched."""
    found = overlapping_texts(docs.select("text"), benchmark)
    per = found.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("words").alias("w"), F.max("matched").alias("m")
    )
    out = docs.select("doc_id", *text_key(F.col("text"))).join(per, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
        F.coalesce("w", F.lit(0)).alias("max_words"),
        F.coalesce("m", F.lit(0)).alias("max_matched"),
    )
