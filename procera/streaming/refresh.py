"""Reuse of loaded frames, for a time or as long as their source stays as it is."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession

from procera.sources.versions import VersionedTable


class TimedCache:
    """Keeps loaded frames cached on the executors.

    A frame loaded with `version`, a callable that tells the state of its source, stays until that changes: a
    save makes exactly the frames of the saved source stale, in every session that asks. Without, a frame
    stays for `ttl` seconds by the driver's clock: the polling refresh.
    """

    def __init__(self, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self._kept: dict[str, tuple[float, Hashable, DataFrame]] = {}

    def get(self, key: str, load: Callable[[], DataFrame], version: Callable[[], Hashable] | None = None) -> DataFrame:
        now, state = self.clock(), version() if version else None
        if key in self._kept:
            at, seen, df = self._kept[key]
            if seen == state if version else now - at < self.ttl:
                return df
            df.unpersist()
        df = load().cache()
        self._kept[key] = (now, state, df)  # the state from before the load: a save in between is noticed next time
        return df

    def drop(self, key: str) -> None:
        """Forget one frame."""
        if key in self._kept:
            self._kept.pop(key)[2].unpersist()

    def clear(self) -> None:
        """Forget everything."""
        for key in list(self._kept):
            self.drop(key)


def table_state(spark: SparkSession, path: str) -> Callable[[], Hashable]:
    """State of a table of files: its version, or names, times and sizes of a plain folder's files."""
    return VersionedTable(spark, path).token


def file_state(path: str) -> Callable[[], Hashable]:
    """State of a database file and its log: times and sizes; None where there is none."""

    def one(name: str) -> tuple[int, int] | None:
        try:
            found = os.stat(name)
        except FileNotFoundError:
            return None
        return found.st_mtime_ns, found.st_size

    return lambda: (one(path), one(f"{path}-wal"))
