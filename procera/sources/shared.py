"""Tables that cut lineage, in the folder that driver and executors share.

Results are lazy and read these tables, so they stay until `release`.

Defined results: a frame without rows is written and read like others, with its schema.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own only under a local master that names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="records-"))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Delete what this session has put into the shared folder. Frames that still read it must be stored before."""
    for item in [x for x in _made if x[0] is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(item[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(item)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of its own: computed once, whatever reads it, and whatever executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
