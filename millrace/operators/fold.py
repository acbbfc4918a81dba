"""Ordered folds: state that one row's decision hands to the next, as a stream.

Rows are dealt by key and sorted within each task; a step function reads one row after another and keeps the key's state,
so the cost is linear in the rows, memory holds one Arrow batch and one state, and no key is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.session import arrow_map

Step = Callable[..., tuple]


def fold(rows: DataFrame, by: list[str], order: list[str], reads: list[str], fresh: Callable[[], Step], adds: str, keeps: list[str] | None = None) -> DataFrame:
    """``rows`` (or its columns ``keeps``) with the columns ``adds`` (name and type of each, as in a schema).

    ``fresh()`` starts a key and gives its step: a function of the values ``reads`` of a row that returns the row's new
    values, in the order of ``adds``. Rows of equal order come in any order; nulls sort first and are a key like any.
    """
    keeps = rows.columns if keeps is None else keeps
    cols = list(dict.fromkeys([*by, *order, *reads, *keeps]))
    stream = rows.select(*cols).repartition(*by).sortWithinPartitions(*by, *order)
    new = rows.sparkSession.createDataFrame([], adds).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*[rows.schema[c] for c in keeps], *new])

    def run(batches):
        key, step = object(), None  # no key equals it
        for batch in batches:
            at = batch.schema.get_field_index
            keys = zip(*(batch.column(at(c)).to_pylist() for c in by), strict=True)
            values = zip(*(batch.column(at(c)).to_pylist() for c in reads), strict=True)
            out = []
            for k, v in zip(keys, values, strict=True):
                if k != key:
                    key, step = k, fresh()
                out.append(step(*v))
            made = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keeps), *made], names=[*keeps, *names])

    names = [f.name for f in new]
    arrow = [_arrow(f.dataType.simpleString()) for f in new]
    return arrow_map(stream, run, kinds)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("decimal"):
        return pa.decimal128(*map(int, kind[8:-1].split(",")))
    return {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[kind]
