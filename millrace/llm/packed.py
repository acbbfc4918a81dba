"""Arrays of whole numbers as compact bytes, for rows that carry many values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length and of numbers from 0 on, each in the least unsigned type that holds it, compressed."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        out += [kind.char.encode(), x.astype(kind).tobytes()]
    plain = b"".join(out)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    plain = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(plain[:8], "little"), 8, []
    while at < len(plain):
        kind = np.dtype(plain[at : at + 1].decode())
        out.append(np.frombuffer(plain, kind, n, at + 1).astype(np.int64))
        at += 1 + n * kind.itemsize
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several runs."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
