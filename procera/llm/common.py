"""Shared pieces: words, let-bindings, tables in the cluster's shared folder, checked broadcasts.

Defined results: NULL, empty and blank texts have no words; texts of any length are taken whole; tables without rows
are written and read like others; `packed` keeps columns apart from added ones of the same name.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a counted side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def words(text: Column) -> Column:
    """Array of the words of `text`; empty for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, also where `body` refers to it in a lambda."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where the session names none, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        path = _own[app]
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: each row is computed once and the lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time: tables written from here on are those `since` it."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Delete the tables that `written` left for this session since a `mark`, but for the `last` ones, once their results are stored."""
    for item in [x for x in _written[since : len(_written) - last] if x[0] is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(item[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(item)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if its size and its counted rows allow; else leave the join to shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of its files
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= most else df


def packed(docs: DataFrame, *names: str | Column) -> DataFrame:
    """All columns in one struct `row`, beside the named ones: added columns then clash with none of them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *names)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
