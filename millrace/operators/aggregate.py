"""Aggregates of a user in two phases: partial states by Arrow batch, merged by key, so that no group is gathered.

An aggregate is an initial state, a step that takes one row's values, a merge of two states and a result. Each Arrow batch is
reduced to one state a key before the shuffle; states of a key then meet in a sorted stream and are merged one after another,
so a task holds one state of the key it is at, however many rows the key has. States must not depend on the order in which
rows and states come.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.operators.fold import _arrow
from millrace.session import arrow_map


@dataclass
class Aggregate:
    start: Callable[[], Any]
    add: Callable[..., Any]  # (state, *values of a row) -> state
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], tuple]
    adds: str  # names and types of the result


def aggregate(df: DataFrame, by: list[str], reads: list[str], how: Aggregate) -> DataFrame:
    """``<by>`` and what ``how`` adds, one row a key. Nulls are a key like any."""
    rows = df.select(*dict.fromkeys([*by, *reads]))
    keys = ", ".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}" for c in by)
    new = df.sparkSession.createDataFrame([], how.adds).schema
    names, kinds = [f.name for f in new], [_arrow(f.dataType.simpleString()) for f in new]

    def partial(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            states: dict[tuple, Any] = {}
            own = zip(*(batch.column(at(c)).to_pylist() for c in by), strict=True)
            values = zip(*(batch.column(at(c)).to_pylist() for c in reads), strict=True)
            for key, v in zip(own, values, strict=True):
                states[key] = how.add(states[key] if key in states else how.start(), *v)
            if states:
                columns = [pa.array(c, batch.column(at(n)).type) for n, c in zip(by, zip(*states, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*by, "__state"])

    def merged(batches):
        key, state, types = None, None, None
        for batch in batches:
            types = [batch.column(i).type for i in range(len(by))]
            done = []
            for *own, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and own == key:
                    state = how.merge(state, pickle.loads(packed))
                else:
                    if key is not None:
                        done.append((*key, *how.result(state)))
                    key, state = own, pickle.loads(packed)
            if done:
                yield table(done, types)
        if key is not None:
            yield table([(*key, *how.result(state))], types)

    def table(done, types):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [*types, *kinds], strict=True)], names=[*by, *names])

    states = arrow_map(rows, partial, f"{keys}, __state binary").repartition(*by).sortWithinPartitions(*by)
    return arrow_map(states, merged, f"{keys}, {how.adds}")


def first_n(n: int, sep: str = " ", adds: str = "body string, item_count long") -> Aggregate:
    """The texts of the ``n`` first rows by their order, joined, and the count of all: reads (order..., text)."""

    def cut(rows):
        return heapq.nsmallest(n, rows, key=lambda r: r[:-1])

    def add(state, *row):
        count, rows = state
        rows.append(row)
        return count + 1, cut(rows) if len(rows) > 4 * n else rows

    def result(state):
        return sep.join(r[-1] for r in cut(state[1]) if r[-1] is not None), state[0]

    return Aggregate(lambda: (0, []), add, lambda a, b: (a[0] + b[0], cut([*a[1], *b[1]])), result, adds)


def ordered_unique(sep: str = ",", adds: str = "kinds string") -> Aggregate:
    """Distinct values in the order of their first rows: reads (order, value). The state holds each value once."""

    def add(state, order, value):
        if value is not None and (value not in state or order < state[value]):
            state[value] = order
        return state

    def merge(a, b):
        for value, order in b.items():
            add(a, order, value)
        return a

    return Aggregate(dict, add, merge, lambda s: (sep.join(sorted(s, key=lambda v: (s[v], v))),), adds)


def last_message(adds: str = "n int, last_role string") -> Aggregate:
    """Reducer over messages: how many there are and the role of the last: reads (turn, role). Of equal turns the greater role
    counts; a message without a turn comes before all."""
    rank = lambda turn, role: (turn is not None, turn or 0, role or "")

    def add(state, turn, role):
        count, best = state
        new = (rank(turn, role), role)
        return count + 1, new if best is None or new[0] >= best[0] else best

    def merge(a, b):
        return a[0] + b[0], max((x for x in (a[1], b[1]) if x is not None), key=lambda x: x[0], default=None)

    return Aggregate(lambda: (0, None), add, merge, lambda s: (s[0], s[1][1] if s[1] else None), adds)
