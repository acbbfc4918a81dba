"""Vectorised text primitives over Arrow string columns (numpy only).

All functions work on whole texts, a bounded number of bytes at a time: ``chunks`` cuts a batch of rows into slices of
about ``CHUNK_BYTES`` (at least one row), so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def _table(word: set[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(word)] = True
    return t


#: Word bytes when words are whatever stands between ASCII white space.
NOT_SPACE = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Word bytes when words are ASCII letters and digits and all non-ASCII characters.
ALNUM = _table({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)})
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int, _cache: list = [np.ones(1, U64)]) -> np.ndarray:
    if len(_cache[0]) < n:
        p = np.full(max(n, 64), _BASE, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _cache[0] = np.multiply.accumulate(p)
    return _cache[0]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return b, off - off[0]


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of slices of about CHUNK_BYTES."""
    if not len(col):
        return
    b, off = raw(col)
    row = 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, b[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(b: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_SPACE, lower: bool = True):
    """(hash of each word, start, end, offsets of the rows into the words)."""
    if not len(b):
        e = np.empty(0, np.int64)
        return np.empty(0, U64), e, e, np.zeros(len(off), np.int64)
    if lower:
        b = _LOWER[b]
    on = table[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True  # a row's end parts words of neighbouring rows
    before = np.empty_like(on)
    before[0] = False
    before[1:] = on[:-1]
    starts = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.empty_like(on)
    after[-1] = False
    after[:-1] = on[1:]
    ends = np.flatnonzero(on & (~after | edge[1:])) + 1
    woff = np.searchsorted(starts, off)
    if not len(starts):
        return np.empty(0, U64), starts, ends, woff
    lens = ends - starts
    with np.errstate(over="ignore"):
        run = np.arange(len(b), dtype=np.int64)
        first = np.zeros(len(b), np.int64)
        first[starts] = starts
        place = run - np.maximum.accumulate(first)
        place[~on] = 0
        value = np.where(on, b.astype(U64) + U64(1), U64(0)) * _powers(int(lens.max()) + 1)[place]
        h = np.add.reduceat(value, starts)
        return mix(h + lens.astype(U64) * U64(0xD1B54A32D192ED03)), starts, ends, woff


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and row offsets; a row with fewer words has its whole sequence as its one shingle."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(count)])
    if not soff[-1]:
        return np.empty(0, U64), soff
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(soff[-1]) - soff[row] + woff[row]
    size = np.minimum(n, k)[row]
    with np.errstate(over="ignore"):
        s = size.astype(U64) * U64(0xA0761D6478BD642F)
        for j in range(k):
            more = size > j
            s = np.where(more, mix(s ^ h[np.minimum(at + j, len(h) - 1)]) + U64(j), s)
    return s, soff


def hash_words(texts: list[str], **kw) -> np.ndarray:
    """Word hashes of single words, for lexicons."""
    b, off = raw(pa.array(texts, pa.large_string()))
    h, _, _, woff = words(b, off, **kw)
    return h[woff[:-1]]


def whole_groups(batches, keys: int) -> Iterator[pa.Table]:
    """The sorted stream cut at group ends; a group is held whole, and groups are bounded by construction."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        k = np.stack([t.column(i).to_numpy() for i in range(keys)])
        same = (k == k[:, -1:]).all(0)
        cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
