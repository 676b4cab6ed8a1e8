"""Indicators, domains, counts, shares, top-k and monthly series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procera.functions.scalars import month, month_or_marker, short_name, whole
from procera.operators.filters import Filters
from procera.schema import COUNT_LABELS, ORDER, RECORD_COLUMNS, has, ordered

#: Distinct values that become columns.
MOST_VALUES = 1000


def record_view(df: DataFrame, display: bool = True) -> DataFrame:
    """The record grid's columns, in order, where present; original names for export."""
    picked = df.select([c for c in RECORD_COLUMNS if has(df, c)])
    return picked.withColumnsRenamed({c: n for c, n in RECORD_COLUMNS.items() if has(picked, c)}) if display else picked


def kpi(df: DataFrame) -> DataFrame:
    """One row: rows, distinct patients, distinct surgeons, mean duration cut to whole minutes."""
    number = lambda c, expr: expr if has(df, c) else F.lit(0)
    return df.agg(
        F.count("*").alias("total"),
        number("cpf", F.countDistinct("cpf")).cast("bigint").alias("pacientes"),
        number("cirurgiao", F.countDistinct("cirurgiao")).cast("bigint").alias("cirurgioes"),
        number("duracao_minutos", whole(F.avg("duracao_minutos"))).cast("int").alias("duracao_media"),
    )


def bounds(df: DataFrame, column: str = "data_inicio") -> DataFrame:
    return df.agg(F.min(column).alias("minimo"), F.max(column).alias("maximo"))


def domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values without NULL; no rows where the column is absent."""
    if not has(df, column):
        return df.sparkSession.createDataFrame([], f"{column} string")
    return df.select(column).dropna().distinct().orderBy(column)


def first_seen(df: DataFrame, column: str, order: str = ORDER) -> list:
    """Distinct values in order of first appearance, NULL included. One driver row per value, MOST_VALUES at most."""
    rows = df.groupBy(column).agg(F.min(ordered(df, order)).alias("_at")).orderBy("_at").limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"{column} has more than {MOST_VALUES} different values")
    return [r[0] for r in rows]


def domains(df: DataFrame, columns: Iterable[str] = Filters.MEMBERSHIP) -> DataFrame:
    """All filters' domains in one pass over `df`: (coluna, valor), sorted, without NULL; absent columns have no rows."""
    pairs = [F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("valor")) for c in columns if has(df, c)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "coluna string, valor string")
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("valor IS NOT NULL").distinct().orderBy("coluna", "valor")


def appearance(df: DataFrame, column: str = "tipo_procedimento", order: str = ORDER) -> DataFrame:
    """Distinct values without NULL and their rank of first appearance (from 1); the window runs over one row per value."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(ordered(df, order)).alias("_at"))
    return first.select(column, F.row_number().over(W.orderBy("_at")).cast("bigint").alias("ordem"))


def counted(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """Rows per value without NULL, the value under its label."""
    label = COUNT_LABELS.get(column, column)
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(label)).agg(F.count("*").alias("Total"))
    return rows, label


def value_counts(df: DataFrame, column: str) -> DataFrame:
    rows, label = counted(df, column)
    return rows.orderBy(F.desc("Total"), label)


def top(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return value_counts(df, column).limit(k)


def top_surgeons(df: DataFrame, k: int = 10) -> DataFrame:
    return top(df, "cirurgiao", k).withColumn("Nome", short_name(F.col(COUNT_LABELS["cirurgiao"])))


def share(df: DataFrame, column: str) -> DataFrame:
    """Counts with their percentage; the window runs over one row per category."""
    rows, label = counted(df, column)
    percent = F.round(F.col("Total") * 100.0 / F.sum("Total").over(W.partitionBy()), 4)
    return rows.withColumn("pct", percent).orderBy(F.desc("Total"), label)


def monthly(df: DataFrame) -> DataFrame:
    """Rows per month and procedure type; undated and untyped rows are left out."""
    kept = df.dropna(subset=["data_inicio", "tipo_procedimento"])
    grouped = kept.groupBy(month(F.col("data_inicio")).alias("mes"), "tipo_procedimento")
    return grouped.agg(F.count("*").alias("Total")).orderBy("mes", "tipo_procedimento")


def monthly_of_surgeon(df: DataFrame, surgeon: str) -> DataFrame:
    """Rows per month of one surgeon; undated rows form their own group."""
    kept = df.where(F.col("cirurgiao") == surgeon)
    return kept.groupBy(month_or_marker(F.col("data_inicio")).alias("mes")).agg(F.count("*").alias("Total")).orderBy("mes")
