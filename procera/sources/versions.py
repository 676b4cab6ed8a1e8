"""Tables kept in versions: saving never leaves a reader without rows.

Rows of a version are a folder of their own under ``_data``; a small file under ``_versions``,
numbered and never overwritten, names that folder and its schema: it makes them the table. A reader takes the highest number; one that
has begun keeps its folder until `vacuum` clears it. Of two writers that start from one
version the second is told so (`SaveConflict`), as a number can be made once only.
A plain Parquet folder becomes version 0 of itself: its files stay where they are.

Works through Hadoop's file system interface, so the path may be on any store that refuses to
create a file twice. What a writer leaves that fails before the number is made is not read, and `vacuum` clears it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from procera.schema import ORDER, ROW, SchemaError

END = "\n"


class SaveConflict(RuntimeError):
    """Another version was saved since the one this save starts from."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    schema: StructType


def own_columns(df: DataFrame) -> list[str]:
    """Columns to be stored: without the places that a loader added (`_row`, and an order that is a place in a file)."""
    kinds = dict(df.dtypes)
    return [c for c in df.columns if c != ROW and not (c == ORDER and kinds[c].startswith("struct<file:"))]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _listed(self, folder: str) -> list:
        try:
            return [s for s in self._fs.listStatus(self._file(self.path, folder)) if not s.getPath().getName().startswith((".", "_"))]
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                return []
            raise

    def _named(self, number: int) -> dict | None:
        """Folder and schema of a version; None while its file is being written."""
        stream = self._fs.open(self._file(self.path, "_versions", str(number)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith(END) else None

    def versions(self) -> list[int]:
        return sorted(int(n) for s in self._listed("_versions") if (n := s.getPath().getName()).isdigit())

    def current(self) -> Version | None:
        """The highest version; None for a path without one (a plain folder, or nothing)."""
        for number in reversed(self.versions()):
            if named := self._named(number):
                return Version(number, f"{self.path}/_data/{named['folder']}", StructType.fromJson(named["schema"]))
        return None

    def token(self) -> str:
        """Changes with every save, and with every change of the files of a plain folder."""
        now = self.current()
        if now:
            return f"version {now.number}"
        files = sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in self._listed("."))
        return str(files)

    def read(self) -> DataFrame:
        """The current version, or the plain folder; a path that doesn't exist raises as Spark does."""
        now = self.current()
        return self.spark.read.schema(now.schema).parquet(now.folder) if now else self.spark.read.parquet(self.path)

    def save(self, df: DataFrame, base: Version | int | None = None, partition_by: tuple[str, ...] = ()) -> Version:
        """Make `df`'s rows the next version. With `base` (0: the plain folder) only if nobody saved since; without, the last save wins."""
        kept = own_columns(df)
        if not kept:
            raise SchemaError("nothing to save")
        name = uuid.uuid4().hex
        rows = df.select(*(f"`{c}`" for c in kept))
        writer = rows.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/_data/{name}")
        number = 1 + (max(self.versions(), default=0) if base is None else base if isinstance(base, int) else base.number)
        while not self._made(number, {"folder": name, "schema": rows.schema.jsonValue()}):
            if base is not None:
                raise SaveConflict(f"{self.path}: version {number} was saved by another writer")
            number += 1
        self.spark.catalog.refreshByPath(self.path)
        return Version(number, f"{self.path}/_data/{name}", rows.schema)

    def _made(self, number: int, named: dict) -> bool:
        if number <= max(self.versions(), default=0):
            return False
        try:
            stream = self._fs.create(self._file(self.path, "_versions", str(number)), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        try:
            stream.write(bytearray((json.dumps(named) + END).encode()))
        finally:
            stream.close()
        return True

    def vacuum(self, keep: int = 2, seconds: float = 3600) -> None:
        """Delete versions but for the last `keep`, and folders of none, that are older than `seconds`: what readers may still hold stays."""
        numbers = self.versions()
        named = {n: self._named(n) for n in numbers}
        folder = lambda n: (named[n] or {}).get("folder")
        stay = {folder(n) for n in numbers[-keep:]}
        before = (time.time() - seconds) * 1000
        for s in self._listed("_data"):
            if s.getPath().getName() not in stay and s.getModificationTime() < before:
                self._fs.delete(s.getPath(), True)
        left = {s.getPath().getName() for s in self._listed("_data")}
        for n in numbers[:-keep]:
            if folder(n) not in left:
                self._fs.delete(self._file(self.path, "_versions", str(n)), False)
