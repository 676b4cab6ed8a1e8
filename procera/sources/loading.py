"""Scans, path resolution and date normalisation."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procera.functions.scalars import parse_date
from procera.schema import DATE_COLUMNS, FACT, ORDER, ROW, SchemaError, checked, has
from procera.sources.versions import VersionedTable


def resolve(candidates: Iterable[str]) -> str | None:
    """First existing local path, in order of preference."""
    return next((p for p in candidates if os.path.exists(p)), None)


def empty(spark: SparkSession, schema: T.StructType = FACT) -> DataFrame:
    return spark.createDataFrame([], schema)


def normalise_dates(df: DataFrame, columns: Iterable[str] = DATE_COLUMNS, observation: Observation | None = None) -> DataFrame:
    """Parse text dates; columns that already are timestamps keep their values.

    With an `observation`, the first action on the result tells per text column how many values no pattern fits, as `rejected_<column>`,
    in the same pass. Texts that are NULL or blank are no dates and are not counted.
    """
    kinds = dict(df.dtypes)
    present = [c for c in columns if has(df, c)]
    texts = [c for c in present if kinds[c] == "string"]
    parsed = {c: parse_date(F.col(c)) if c in texts else F.col(c).cast("timestamp_ntz") for c in present}
    if not parsed:
        return df
    if observation is None or not texts:
        return df.withColumns(parsed)
    both = df.withColumns({f"_raw_{c}": F.col(c) for c in texts}).withColumns(parsed)
    counts = [F.count_if(told(F.col(f"_raw_{c}")) & F.col(c).isNull()).alias(f"rejected_{c}") for c in texts]
    return both.observe(observation, *counts).drop(*(f"_raw_{c}" for c in texts))


def told(text: Column) -> Column:
    """Whether a text says anything."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def rejected_dates(df: DataFrame, columns: Iterable[str] = DATE_COLUMNS) -> DataFrame:
    """(coluna, texto, linhas): the texts of a raw frame that no pattern fits, and how many rows have them."""
    kinds = dict(df.dtypes)
    pairs = [F.struct(F.lit(c).alias("coluna"), F.col(c).alias("texto")) for c in columns if has(df, c) and kinds[c] == "string"]
    if not pairs:
        return df.sparkSession.createDataFrame([], "coluna string, texto string, linhas bigint")
    texts = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(told(F.col("texto"))).groupBy("coluna", "texto").agg(F.count("*").alias("linhas"))
    return texts.where(parse_date(F.col("texto")).isNull())


def with_order(df: DataFrame, name: str = ORDER) -> DataFrame:
    """`df`, a scan of files, with its rows' places in the source: file path and row index, from the reader, without a shuffle.

    Places sort as the rows stand: files by path, rows as in the file. A frame that has the column keeps it.
    """
    if has(df, name):
        return df
    try:
        return df.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name), "*")
    except AnalysisException as e:
        raise SchemaError(f"the source tells no row order; add a column {name}") from e


def load_parquet(spark: SparkSession, path: str, schema: T.StructType = FACT, order: str = ORDER) -> DataFrame:
    """Lazy scan, of the current version where the table has some, with the rows' order; a missing path gives an empty frame of `schema`."""
    try:
        df = VersionedTable(spark, path).read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)
    return normalise_dates(with_order(checked(df), order))


def load_table(spark: SparkSession, name: str, schema: T.StructType, order: str = ROW) -> DataFrame:
    """Catalog table of Parquet files, with its rows' order, if present, else an empty frame (the optional research sheet)."""
    return with_order(checked(spark.table(name)), order) if spark.catalog.tableExists(name) else empty(spark, schema)


def load_sqlite(spark: SparkSession, path: str | None, table: str, schema: T.StructType = FACT, order: str = ORDER) -> DataFrame:
    """Table or view of a SQLite file through the Python data source, with its rows' order; missing file or relation: empty."""
    from procera.sources.sqlite import SqliteDataSource, relation_names

    if path is None or not os.path.exists(path) or table not in relation_names(path):
        return empty(spark, schema)
    spark.dataSource.register(SqliteDataSource)
    return normalise_dates(checked(spark.read.format("sqlite_table").options(path=path, table=table, order=order).load()))
