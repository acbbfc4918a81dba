"""Sources and sinks of a user's own on Spark's Python data source API: a feed of server-sent events with offsets, and tables
behind a DB-API driver with batched, parametrised inserts.

``event_feed`` reads a folder of segments, text files of server-sent events, in order of their paths. A feed grows by segments
whose paths sort after those that are there (numbered subfolders). Batch or stream: a stream's offset is the number of segments
read, kept in the query's checkpoint, so a stopped query goes on without loss or repeat; each segment is a partition. A
connection that breaks within a segment is opened again at the first message not yet handed on.

``dbapi`` writes rows in two steps: every task inserts its rows, some at a time, into a staging table of its own, and the commit
moves all of them in one transaction inside the database, so readers see all rows or none; an abort drops what was staged.
It reads a table in ranges of its row numbers. Options name the driver module and the connection; staging, catalogue and row
numbers are in SQLite's words (``sqlite3`` and a file that all executors share is the default). Rows pass through no single process.
"""

from __future__ import annotations

import importlib
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FEED_SCHEMA = "id long, event string, data string"
ROWS_AT_A_TIME = 500


# --- server-sent events ---------------------------------------------------------------------------------------------


def _segments(path: str) -> list[str]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/")))


def _opened(path: str, segment: str):
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(segment)


def _message(lines: list[str]) -> tuple[int | None, str | None, str] | None:
    fields: dict[str, list[str]] = {}
    for line in lines:
        name, _, value = line.partition(":")
        if name:
            fields.setdefault(name, []).append(value.removeprefix(" "))
    if "data" not in fields:
        return None
    last = fields.get("id", [""])[-1]
    return int(last) if last.lstrip("-").isdigit() else None, fields.get("event", [None])[-1], "\n".join(fields["data"])


def messages(path: str, segment: str, retries: int = 3, wait: float = 0.1, opened=_opened) -> Iterator[tuple]:
    """(id, event, data) of a segment; after a broken read the segment is opened again past the last whole message."""
    done, failures = 0, 0
    while True:
        try:
            with opened(path, segment) as f:
                f.seek(done)
                rest = b""
                while chunk := f.read(1 << 20):
                    *blocks, rest = (rest + chunk).replace(b"\r\n", b"\n").split(b"\n\n")
                    for block in blocks:
                        got = _message(block.decode("utf-8", "replace").split("\n"))
                        done += len(block) + 2
                        if got:
                            yield got
                    failures = 0
                if rest.strip() and (got := _message(rest.decode("utf-8", "replace").split("\n"))):
                    yield got
                return
        except OSError:
            failures += 1
            if failures > retries:
                raise
            time.sleep(wait)


@dataclass
class Segment(InputPartition):
    path: str
    name: str


class _FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Segment(self.path, s) for s in _segments(self.path)]

    def read(self, partition):
        yield from messages(partition.path, partition.name)


class _FeedStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        return {"segments": len(_segments(self.path))}

    def partitions(self, start: dict, end: dict):
        return [Segment(self.path, s) for s in _segments(self.path)[start["segments"] : end["segments"]]]

    def read(self, partition):
        yield from messages(partition.path, partition.name)

    def commit(self, end: dict) -> None:
        """Offsets live in the query's checkpoint; segments stay."""


class EventFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FeedStream(self.options["path"])


# --- tables behind a DB-API driver ------------------------------------------------------------------------------------


def _connect(options):
    return importlib.import_module(options.get("driver", "sqlite3")).connect(options["connection"], **({"timeout": 120} if options.get("driver", "sqlite3") == "sqlite3" else {}))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Staged(WriterCommitMessage):
    table: str
    rows: int


@dataclass
class Rows(InputPartition):
    first: int
    past: int


class _Insert(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.options, self.columns, self.overwrite = dict(options), columns, overwrite
        self.stage = f"stage_{uuid.uuid4().hex[:12]}"

    def write(self, iterator) -> Staged:
        table, names, count = f"{self.stage}_{uuid.uuid4().hex[:12]}", ", ".join(map(_quoted, self.columns)), 0
        with _closing(_connect(self.options)) as db:
            db.execute(f"CREATE TABLE {table} ({names})")
            insert = f"INSERT INTO {table} ({names}) VALUES ({', '.join('?' * len(self.columns))})"
            rows = []
            for row in iterator:
                rows.append(tuple(row))
                if len(rows) == int(self.options.get("batch", ROWS_AT_A_TIME)):
                    db.executemany(insert, rows)
                    count, rows = count + len(rows), []
            if rows:
                db.executemany(insert, rows)
            db.commit()
        return Staged(table, count + len(rows))

    def commit(self, messages) -> None:
        names = ", ".join(map(_quoted, self.columns))
        table = _quoted(self.options["table"])
        with _closing(_connect(self.options)) as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {table} ({names})")
            if self.overwrite:
                db.execute(f"DELETE FROM {table}")
            for m in messages:
                if m:
                    db.execute(f"INSERT INTO {table} ({names}) SELECT {names} FROM {m.table}")
            self._sweep(db)
            db.commit()

    def abort(self, messages) -> None:
        with _closing(_connect(self.options)) as db:
            self._sweep(db)
            db.commit()

    def _sweep(self, db) -> None:
        """Staging tables of all attempts of this write, also of tasks that ran twice or failed."""
        kept = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name LIKE ?", (f"{self.stage}_%",))]
        for name in kept:
            db.execute(f"DROP TABLE {name}")


class _closing:
    def __init__(self, db):
        self.db = db

    def __enter__(self):
        return self.db

    def __exit__(self, *_):
        self.db.close()


class _Select(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self):
        with _closing(_connect(self.options)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        n = int(self.options.get("partitions", 4))
        step = -(-(high - low + 1) // n)
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join(map(_quoted, self.columns))
        with _closing(_connect(self.options)) as db:
            found = db.execute(f"SELECT {names} FROM {_quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.past))
            while rows := found.fetchmany(ROWS_AT_A_TIME):
                yield from rows


class DbApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Select(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Insert(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session. What plans a source runs beside the driver without the session's files, so
    this module travels by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (EventFeed, DbApi):
        spark.dataSource.register(source)
