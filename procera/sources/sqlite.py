"""SQLite as a Python data source: typed schema, the rows' order, rowid-range splits, and writes.

Tables with a rowid are read in splits of `rows` rowids; views and tables WITHOUT ROWID
have none and are read whole, in one split. With the option `order` a column of that name comes first: the
rowid, or the row's number in the scan. A relation that has such a column keeps its own.

Filters run in Spark: with this Spark, what a Python reader pushed down for one query
still holds for the next query on the same frame.

The file must be reachable by every executor (a shared mount). Each read split
opens its own read-only connection and streams Arrow batches.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BATCH = 8192
#: Rowids of a split, and splits at most.
SPLIT_ROWS, MOST_SPLITS = 200_000, 10_000
KINDS = (("INT", "bigint", pa.int64()), ("REAL", "double", pa.float64()), ("FLOA", "double", pa.float64()), ("DOUB", "double", pa.float64()))


class SourceError(ValueError):
    """The relation cannot be read as what it declares."""


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def names(path: str, *kinds: str) -> list[str]:
    with connect(path) as db:
        return [r[0] for r in db.execute(f"SELECT name FROM sqlite_master WHERE type IN ({', '.join('?' * len(kinds))}) ORDER BY name", kinds)]


def table_names(path: str) -> list[str]:
    return names(path, "table")


def relation_names(path: str) -> list[str]:
    """Tables and views: whatever a SELECT takes."""
    return names(path, "table", "view")


def columns(path: str, table: str) -> list[tuple[str, str, pa.DataType]]:
    with connect(path) as db:
        found = db.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not found:
        raise SourceError(f"{path} has no relation {table}")
    out = []
    for _, name, declared, *_ in found:
        kind = next(((s, a) for key, s, a in KINDS if key in (declared or "").upper()), ("string", pa.string()))
        out.append((name, *kind))
    return out


def rowid(path: str, table: str) -> str | None:
    """The name under which the relation's rowid can be read; None for views and tables without one."""
    taken = {name.lower() for name, *_ in columns(path, table)}
    if table not in table_names(path):
        return None
    with connect(path) as db:
        for name in ("_rowid_", "rowid", "oid"):
            if name not in taken:
                try:
                    db.execute(f"SELECT {name} FROM {quoted(table)} LIMIT 0")
                except sqlite3.OperationalError:
                    return None
                return name
    return None


class Span(InputPartition):
    """Rowids from low to high (exclusive); the whole relation where there are none."""

    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]
        self.rows = int(options.get("rows", SPLIT_ROWS))
        self.fields = columns(self.path, self.table)
        self.rowid = rowid(self.path, self.table)
        self.order = added_order(options, self.fields)

    def partitions(self) -> list[InputPartition]:
        if self.rowid is None:
            return [Span()]
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min({self.rowid}), max({self.rowid}) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Span(0, 0)]
        step = max(self.rows, -(-(high - low + 1) // MOST_SPLITS))
        return [Span(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fields = [(self.order, "bigint", pa.int64())] * bool(self.order) + self.fields
        schema = pa.schema([(name, kind) for name, _, kind in fields])
        asked = [quoted(name) for name, *_ in self.fields]
        numbered = self.order and self.rowid is None
        if self.order and self.rowid:
            asked.insert(0, self.rowid)
        text, given = f"SELECT {', '.join(asked)} FROM {quoted(self.table)}", []
        if partition.low is not None:
            text += f" WHERE {self.rowid} >= ? AND {self.rowid} < ? ORDER BY {self.rowid}"
            given = [partition.low, partition.high]
        db = connect(self.path)
        try:
            cursor, seen = db.execute(text, given), 0
            while rows := cursor.fetchmany(BATCH):
                held = list(zip(*rows, strict=True))
                if numbered:
                    held.insert(0, tuple(range(seen + 1, seen + 1 + len(rows))))
                seen += len(rows)
                arrays = []
                for (name, kind, arrow), values in zip(fields, held, strict=True):
                    try:
                        arrays.append(pa.array([None if v is None else str(v) for v in values] if kind == "string" else values, arrow))
                    except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
                        raise SourceError(f"column {name} of {self.table} is declared {kind} and holds something else: {e}") from e
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            db.close()


def added_order(options: dict, fields: list[tuple[str, str, pa.DataType]]) -> str | None:
    """The order column that the reader adds: the one asked for, unless the relation has it."""
    name = options.get("order")
    return name if name and name.lower() not in {f[0].lower() for f in fields} else None


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class SqliteWriter(DataSourceWriter):
    """Each task writes a side file next to the target; the commit merges them in one transaction."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = options["path"], options["table"], schema, overwrite

    def ddl(self) -> str:
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL"}
        return ", ".join(f"{quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in self.schema)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        side = f"{self.path}.part-{TaskContext.get().taskAttemptId()}"
        if os.path.exists(side):
            os.remove(side)
        plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
        with sqlite3.connect(side) as db:
            db.execute(f"CREATE TABLE part ({self.ddl()})")
            db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.schema))})", ([plain(v) for v in row] for row in rows))
        db.close()
        return Written(side)

    def commit(self, messages: list) -> None:
        db = sqlite3.connect(self.path, isolation_level=None)
        sides = [m.path for m in messages if m]
        try:
            db.execute("BEGIN")
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {quoted(self.table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({self.ddl()})")
            for side in sides:
                part = sqlite3.connect(side)
                db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", part.execute("SELECT * FROM part ORDER BY rowid"))
                part.close()
            db.execute("COMMIT")
        finally:
            db.close()
            self.clean(sides)

    def abort(self, messages: list) -> None:
        self.clean([m.path for m in messages if m])

    @staticmethod
    def clean(sides: list[str]) -> None:
        for side in sides:
            if os.path.exists(side):
                os.remove(side)


class SqliteDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        fields = columns(self.options["path"], self.options["table"])
        order = added_order(dict(self.options), fields)
        return ", ".join(f"`{name}` {kind}" for name, kind in [(order, "bigint")] * bool(order) + [f[:2] for f in fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(dict(self.options), schema, overwrite)
