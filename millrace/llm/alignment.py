"""Cross-tokenizer alignment by a cogroup of postings.

Every whole text is encoded by two tokenizers: a blank and the text by a byte-level BPE (side A), the text by a sentence-piece
model (side B, which adds the blank). Where tokens of both sides end at the same byte the text is cut into groups; every A and
B token of one group are linked. A pair of ids counts the documents that hold it linked.

One pass over the texts writes, for every slice of documents, one row of *postings* for each of ``BUCKETS`` groups of A ids:
which pairs stand in which of its documents, how often. Document counts of pairs are pre-aggregated by slice and summed; the
highest count of each A id is taken where its pairs meet. Then both are shuffled by A id and cogrouped as one sorted stream,
counts first: a task holds the counts of one bucket and reads the postings of one slice after another, emits what they add to
each document, and these parts are summed by document. A bucket whose postings exceed ``SLOT_BYTES`` is dealt over several
slots by slice, each with the bucket's counts, so an id that stands in every document is split like any other; Spark's sort
spills the streams.

Neither tokenizer joins what stands on both sides of a single blank between two other characters: there A starts a new word,
and B has no piece with its blank inside. Texts are cut there and the pieces looked up in a bounded cache, which gives the same
tokens as the whole text (a test compares them) and bounds memory for very long texts.

Defined results: null and empty texts, texts that are not valid UTF-8, and texts whose tokens do not spell them (those that
hold U+2581, which B cannot tell from a blank) have no tokens: zeros and the empty string. Rows are documents: equal ids,
null ids and repeated texts count once a row. An empty table gives an empty result; columns beyond id and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textvec as tv
from millrace.llm.packed import pack, spread, unpack
from millrace.session import arrow_map, materialise

#: Folder of the tokenizer files and their names.
FOLDER, SIDE_A, SIDE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Groups of A ids; a task holds the pair counts of one.
BUCKETS = 64
#: Bytes of postings beyond which a bucket is dealt over several slots.
SLOT_BYTES = 64 << 20
#: Bytes of text in a slice of documents, and pieces that the cache holds before it starts anew.
SLICE_BYTES, CACHED = 4 << 20, 300_000
#: Pieces that the tokenizers are given at a time: what they return for one is some KB.
LEARNT = 10_000
#: A single blank between two characters that are none: both tokenizers start anew there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_of() -> dict[str, int]:
    """Byte-level entries spell each byte by one character: printable ones by themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers with what they make of the pieces of text seen so far."""

    def __init__(self, a: bytes, b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        byte_of = _byte_of()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry)
        pieces = range(self.b.get_piece_size())
        spelt = lambda p: bytes([int(p[3:5], 16)])
        self.bytes_b = [spelt(self.b.id_to_piece(i)) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []  # the groups of each piece, as its digest takes them
        self.facts = np.zeros((0, 5), np.int64)  # whether it is spelt, n_a, n_b, n_groups, n_links
        self.codes, self.times, self.off = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Tokens, groups and pairs of new pieces, all at once."""
        ids_a = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        ids_b = self.b.encode(pieces, num_threads=1)
        spelt = [(" " + p).encode() for p in pieces]
        good = np.array([self._spells(x, y, s) for x, y, s in zip(ids_a, ids_b, spelt, strict=True)])
        ids_a = [x if g else [] for x, g in zip(ids_a, good, strict=True)]
        ids_b = [x if g else [] for x, g in zip(ids_b, good, strict=True)]
        na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        piece_of = np.repeat(np.arange(len(pieces)), na)[np.cumsum(in_a) - 1] if len(cuts) else np.zeros(0, np.int64)
        self._names(flat_a, flat_b, in_a, in_b, piece_of, len(pieces))
        code, times, of = self._pairs(flat_a, flat_b, group_a, group_b, len(cuts), piece_of)
        n = len(pieces)
        links = np.bincount(piece_of, in_a * in_b, n).astype(np.int64)
        facts = np.stack([good.astype(np.int64), na, nb, np.bincount(piece_of, minlength=n), links], axis=1)
        first = len(self.text) - n
        self.known.update(zip(pieces, range(first, first + n), strict=True))
        self.facts = np.concatenate([self.facts, facts])
        self.codes, self.times = np.concatenate([self.codes, code]), np.concatenate([self.times, times])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.bincount(of, minlength=n))])

    def _spells(self, a: list[int], b: list[int], spelt: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == spelt and b"".join([self.bytes_b[i] for i in b]) == spelt

    def _names(self, flat_a, flat_b, in_a, in_b, piece_of, n: int) -> None:
        a, b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        x, y, out = 0, 0, [[] for _ in range(n)]
        for p, i, j in zip(piece_of.tolist(), in_a.tolist(), in_b.tolist(), strict=True):
            out[p].append(f"{a[x] if i == 1 else ','.join(a[x : x + i])}|{b[y] if j == 1 else ','.join(b[y : y + j])}")
            x, y = x + i, y + j
        self.text += [";".join(g) for g in out]

    def _pairs(self, flat_a, flat_b, group_a, group_b, n_groups: int, piece_of):
        """(pair, times linked, piece) of distinct ids in each group, in order of pieces."""
        va, vb = len(self.bytes_a), len(self.bytes_b)
        key_a, n_a = np.unique(group_a * va + flat_a, return_counts=True)
        key_b, n_b = np.unique(group_b * vb + flat_b, return_counts=True)
        of_a = key_a // va
        sizes = np.bincount(key_b // vb, minlength=n_groups)
        starts = np.cumsum(sizes) - sizes
        at = spread(starts[of_a], sizes[of_a])
        left = np.repeat(np.arange(len(key_a)), sizes[of_a])
        return (key_a % va)[left] * vb + (key_b % vb)[at], n_a[left] * n_b[at], piece_of[of_a[left]]

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, offsets of the texts)."""
        if len(self.text) > CACHED:
            self.forget()
        pieces, off = [], [0]
        for t in texts:
            if t:
                pieces += _CUT.split(t)
            off.append(len(pieces))
        new = list(dict.fromkeys(p for p in pieces if p not in self.known))
        for i in range(0, len(new), LEARNT):
            self.learn(new[i : i + LEARNT])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)), np.array(off)


_aligners: dict[str, Aligner] = {}


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    """One for each worker and pair of files."""
    key = hashlib.sha256(files[0] + files[1]).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(*files)
    return _aligners[key]


def _decoded(text: bytes | None) -> str | None:
    try:
        return text.decode() if text else None
    except UnicodeDecodeError:
        return None


def _slices(texts: list[str | None]):
    """(first, past last) of runs of about SLICE_BYTES."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > SLICE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if texts:
        yield first, len(texts)


def _aligned(al: Aligner, texts: list[str | None]):
    """(n_a, n_b, n_groups, n_links and digest of each text; bucket, pairs and postings of each bucket)."""
    ids, off = al.look_up(texts)
    n = len(texts)
    total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(al.facts[ids], axis=0)])
    counts = total[off[1:]] - total[off[:-1]]
    spelt = counts[:, 0] == np.diff(off)
    counts[~spelt] = 0
    names = al.text
    digests = [hashlib.sha256(";".join([names[i] for i in ids[off[d] : off[d + 1]].tolist()]).encode()).hexdigest() if spelt[d] and off[d] < off[d + 1] else "" for d in range(n)]
    doc = np.repeat(np.arange(n), np.diff(off))
    keep = spelt[doc]
    held, times = np.unique(doc[keep] * max(1, len(al.text)) + ids[keep], return_counts=True)
    piece, doc = held % max(1, len(al.text)), held // max(1, len(al.text))
    sizes = al.off[piece + 1] - al.off[piece]
    at = spread(al.off[piece], sizes)
    code, doc, m = al.codes[at], np.repeat(doc, sizes), al.times[at] * np.repeat(times, sizes)
    bucket = _bucket(code // len(al.bytes_b))
    order = np.lexsort((doc, code, bucket))
    code, doc, m, bucket = code[order], doc[order], m[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
    m = np.add.reduceat(m, first) if len(first) else m
    code, doc, bucket = code[first], doc[first], bucket[first]
    edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    parts = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        a, z = edges[k], edges[k + 1]
        pairs, docs = np.unique(code[a:z], return_counts=True)
        parts.append((k, pack(np.diff(pairs, prepend=0), docs), pack(doc[a:z], m[a:z])))
    return counts[:, 1:], digests, parts


def _bucket(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tv.mix(a.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def tokenizer_files(folder: str = FOLDER, a: str = SIDE_A, b: str = SIDE_B) -> tuple[bytes, bytes]:
    return Path(folder, a).read_bytes(), Path(folder, b).read_bytes()


def encode(docs: DataFrame, files: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written pass over all texts: a row for each document (``row, id, n_a, n_b, n_groups, n_links, groups_sha256``) and
    one for each slice and bucket (``row`` of the slice's first document, ``bucket, pairs, docs``)."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = base.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(files)  # two tokenizers' files, some MB
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "bucket", "pairs", "docs"]

    def run(batches):
        al = _aligner(shared.value)
        for batch in batches:
            texts = [_decoded(t) for t in batch.column(2).to_pylist()]
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            for a, z in _slices(texts):
                counts, digests, parts = _aligned(al, texts[a:z])
                none = lambda kind, n: pa.nulls(n, kind)
                columns = [pa.array(rows[a:z]), ids.slice(a, z - a), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(4)), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, none(pa.int32(), z - a), none(pa.binary(), z - a), none(pa.binary(), z - a)], names=names)
                if parts:
                    n = len(parts)
                    columns = [pa.array(np.full(n, rows[a])), none(ids.type, n), *(none(pa.int64(), n) for _ in range(4)), none(pa.string(), n)]
                    own = [pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[i] for p in parts], pa.binary()) for i in (1, 2))]
                    yield pa.RecordBatch.from_arrays([*columns, *own], names=names)

    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, pairs binary, docs binary"
    return materialise(arrow_map(base, run, schema), "postings")[0]


def pair_counts(encoded: DataFrame, side_b: int) -> DataFrame:
    """``bucket, code, n, best``: in how many documents each pair of ids (``code`` = A id * ``side_b`` + B id) is linked, and
    whether no pair of its A id has more."""

    def run(batches):
        for batch in batches:
            found = [(k, *unpack(p)) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if not found:
                continue
            bucket = np.concatenate([np.full(len(d), k) for k, d, _ in found])
            code, n = np.concatenate([np.cumsum(d) for _, d, _ in found]), np.concatenate([x for *_, x in found])
            keys, first, at = np.unique(code, return_index=True, return_inverse=True)
            n = np.bincount(at, n, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(keys), pa.array(n)], names=["bucket", "code", "n"])

    parts = arrow_map(encoded.filter("bucket IS NOT NULL").select("bucket", "pairs"), run, "bucket int, code long, n long")
    counts = parts.groupBy("bucket", "code").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.expr(f"code div {side_b}"))  # at most side_b pairs
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def _slots(encoded: DataFrame) -> list[int]:
    """Slots of each bucket, by the bytes of its postings."""
    sizes = encoded.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum(F.length("docs") + F.length("pairs")).alias("n")).collect()  # BUCKETS rows
    of = {r["bucket"]: r["n"] for r in sizes}
    return [1 + of.get(k, 0) // SLOT_BYTES for k in range(BUCKETS)]


def contributions(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` of every document that has tokens: the cogroup of postings and counts."""
    slots = _slots(encoded)
    many, base = F.array(*map(F.lit, slots)), F.array(*[F.lit(int(n)) for n in np.cumsum([0, *slots[:-1]])])
    of = lambda place: F.get(base, F.col("bucket")) + place
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.get(many, F.col("bucket")) - 1)))
    first = first.select(of(F.col("slot")).alias("slot"), F.lit(0).alias("kind"), "code", "n", "best", nothing("binary", "pairs"), nothing("binary", "docs"))
    then = encoded.filter("bucket IS NOT NULL").select(
        of(F.pmod(F.xxhash64("row"), F.get(many, F.col("bucket")).cast("long")).cast("int")).alias("slot"), F.lit(1).alias("kind"),
        F.col("row").alias("code"), nothing("long", "n"), nothing("boolean", "best"), "pairs", "docs",
    )
    stream = first.unionByName(then).repartition("slot").sortWithinPartitions("slot", "kind", "code")

    def run(batches):
        slot, parts, table = None, [], None
        for batch in batches:
            slots, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.diff(slots, prepend=slots[:1] - 1)).tolist() if len(slots) else []
            out = []
            for a, z in zip(edges, [*edges[1:], len(slots)], strict=True):
                if slots[a] != slot:
                    slot, parts, table = slots[a], [], None
                mid = a + int(np.searchsorted(kinds[a:z], 1))
                if mid > a:
                    parts.append([batch.column(i).slice(a, mid - a).to_numpy(zero_copy_only=False) for i in (2, 3, 4)])
                for i in range(mid, z):
                    if table is None:
                        table = [np.concatenate(x) for x in zip(*parts, strict=True)]
                        table[2] = table[2].astype(bool)
                    out.append(_added(table, batch.column(2)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["row", "n_best", "count_sum"])

    parts = arrow_map(stream, run, "row long, n_best long, count_sum long")
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _added(table: list[np.ndarray], first: int, pairs: bytes, docs: bytes):
    """(row, n_best, count_sum) that one slice's postings of one bucket add."""
    codes, n, best = table
    step, held = unpack(pairs)
    at = np.repeat(np.searchsorted(codes, np.cumsum(step)), held)
    doc, m = unpack(docs)
    some = np.unique(doc)
    place = np.searchsorted(some, doc)
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(len(some)))
    sums = [np.add.reduceat(x[order], edges) for x in (np.where(best[at], m, 0), m * n[at])]  # whole numbers, not floats
    return first + some, *sums


def align(docs: DataFrame, files: tuple[bytes, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    files = files or tokenizer_files()
    encoded = encode(docs, files, id_col, text_col)
    counts, _ = materialise(pair_counts(encoded, len(Aligner(*files).bytes_b)), "pair-counts")
    own = encoded.filter("bucket IS NULL").drop("bucket", "pairs", "docs").join(contributions(encoded, counts), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12(docs: DataFrame) -> DataFrame:
    return align(docs.select("doc_id", "text"))
