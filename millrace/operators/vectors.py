"""Stated query vectors against all vectors, as products of matrices.

Vectors are packed into blocks where they lie, the queries too; each block of vectors meets each block of queries once, and a
task works out a block's scores at once. Top-k searches keep the k best of each query in a task, so that only these are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.blockmax import Best
from millrace.operators.core import with_each
from millrace.session import arrow_map, materialise

#: Vectors and queries in a block; a block of scores has as many numbers as their product.
ROWS, QUERIES = 4096, 256


def _packed(rows: DataFrame, size: int, as_sql: bool = False) -> DataFrame:
    """``ids, unit, dim``: blocks of up to ``size`` vectors (``id, v``; null vectors left out) scaled to length 1, in doubles.
    Vectors of a length of their own stand in blocks of their own; those of length 0 stay 0 and score 0. ``as_sql``: squares are
    summed one after the other, a length of 0 gives NaN as any division by it, and vectors with a null component are left out."""

    def run(batches):
        for batch in batches:
            kept = batch.filter(pc.is_valid(batch.column(1)))
            sizes = pc.list_value_length(kept.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for a in range(0, len(at), size):
                    own = kept.take(pa.array(at[a : a + size]))
                    flat = own.column(1).flatten().to_numpy(zero_copy_only=False)
                    m = flat.astype(np.float64).reshape(own.num_rows, int(dim))
                    if as_sql:
                        whole = pc.is_valid(own.column(1).flatten()).to_numpy(zero_copy_only=False).reshape(m.shape).all(axis=1)
                        own, m = own.filter(pa.array(whole)), m[whole]
                        with np.errstate(all="ignore"):
                            unit = m / np.sqrt(np.cumsum(m * m, axis=1)[:, -1:])
                    else:
                        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                        unit = np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)
                    ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([unit.tobytes()], pa.binary()), pa.array([int(dim)], pa.int32())], names=["ids", "unit", "dim"])

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows.select("id", "v"), run, f"ids array<{kind}>, unit binary, dim int")


def _met(vectors: DataFrame, queries: DataFrame, as_sql: bool = False) -> DataFrame:
    """``qids, qunit, ids, unit, dim`` of every block of vectors beside every block of queries of the same dimension. The queries are
    written, which tells their size; the vectors are packed as they are met."""
    v = _packed(vectors, ROWS, as_sql)
    q = materialise(_packed(queries, QUERIES, as_sql), "queries")[0].select(F.col("ids").alias("qids"), F.col("unit").alias("qunit"), F.col("dim").alias("qdim"))
    return with_each(v, q).filter("dim = qdim").select("qids", "qunit", "ids", "unit", "dim")


def _scores(batch: pa.RecordBatch):
    """(query ids, ids, scores to eight places by query and vector) of each pair of blocks."""
    for i in range(batch.num_rows):
        qids, ids = (batch.column(c)[i].values for c in (0, 2))
        dim = batch.column(4)[i].as_py()
        q, v = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(len(x), dim) for c, x in ((1, qids), (3, ids)))
        yield qids, ids, q @ v.T


def _schema(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: the k largest cosines of every query (``id, v``) in each task, ties to smaller ids."""

    def run(batches):
        best: dict = {}
        for batch in batches:
            for qids, ids, score in _scores(batch):
                score += 2.0  # above 0, where the empty list of a query begins
                own = best.setdefault((len(qids), qids[0].as_py()), (qids, Best(k, len(qids))))[1]
                q, at = np.nonzero(score >= own.least[:, None])
                if len(q):
                    own.add(q, score[q, at], ids.take(pa.array(at)))
        for qids, own in best.values():
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(own.q)), own.ids, pa.array(own.score - 2.0)], names=["query_id", "id", "score"])

    return arrow_map(_met(vectors, queries), run, _schema(vectors, queries))


def above(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, id, score`` of all pairs whose cosine is ``least`` or more, to the eighth place; callers compare exactly."""

    def run(batches):
        for batch in batches:
            for qids, ids, score in _scores(batch):
                q, at = np.nonzero(score >= least - 1e-7)
                for a in range(0, len(q), 100_000):
                    x, y = q[a : a + 100_000], at[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(score[x, y])], names=["query_id", "id", "score"])

    return arrow_map(_met(vectors, queries), run, _schema(vectors, queries))


def over(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, id`` of all pairs whose unit vectors have a product above ``least``, as SQL has it to the last bit: products close
    to it are summed again one after the other, and NaN (of a zero or non-finite vector) is above any number."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids = (batch.column(c)[i].values for c in (0, 2))
                dim = batch.column(4)[i].as_py()
                q, v = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(len(x), dim) for c, x in ((1, qids), (3, ids)))
                with np.errstate(all="ignore"):
                    x, y = np.nonzero(~(q @ v.T <= least - 1e-9))
                for a in range(0, len(x), 20_000):
                    s, t = x[a : a + 20_000], y[a : a + 20_000]
                    score = np.cumsum(q[s] * v[t], axis=1)[:, -1] if dim else np.zeros(len(s))
                    good = ~(score <= least)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(s[good])), ids.take(pa.array(t[good]))], names=["query_id", "id"])

    return arrow_map(_met(vectors, queries, True), run, _schema(vectors, queries).removesuffix(", score double"))
