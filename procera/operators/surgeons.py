"""Surgeon ranking and its pivot by procedure type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.functions.scalars import truncated_header, whole
from procera.operators.overview import first_seen
from procera.schema import ORDER, OTHER_TYPE, RANKING_COLUMNS, has, ordered


def measures() -> list[F.Column]:
    return [
        F.count("prontuario").alias("Total"),
        F.countDistinct("cpf").alias("Pacientes"),
        whole(F.avg("duracao_minutos")).alias("Dur_media"),
        F.min("data_inicio").alias("Primeiro"),
        F.max("data_inicio").alias("Ultimo"),
    ]


def ranking(df: DataFrame) -> DataFrame:
    """Per surgeon: chart numbers, distinct patients, whole mean duration, first and last date."""
    kept = df.where(F.col("cirurgiao").isNotNull())
    return kept.groupBy("cirurgiao").agg(*measures()).orderBy(F.desc("Total"), "cirurgiao")


def cells(df: DataFrame, values: list[str | None] | None = None, truncate: bool = False) -> dict[str, F.Column]:
    """One chart-number count per procedure type, by header.

    A missing surgeon/type pair is NULL; a present pair without chart numbers is 0; a type that is NULL or empty equals no
    record's type, so its cells are NULL. Columns follow first appearance unless `values` are given.
    """
    values = first_seen(df, "tipo_procedimento") if values is None else values
    taken: set[str] = set()
    out = {}
    for value in values:
        here = F.col("tipo_procedimento") == F.lit(value)
        count = F.when(F.count(F.when(here, 1)) > 0, F.count(F.when(here, F.col("prontuario"))))
        out[truncated_header(value, taken) if truncate else value or OTHER_TYPE] = count if value else F.lit(None).cast("bigint")
    return out


def ranking_pivot(df: DataFrame, values: list[str] | None = None, truncate: bool = False) -> DataFrame:
    """Ranking plus a count per procedure type: one conditional aggregation in place of a pass and a join per type."""
    by_type = [c.alias(name) for name, c in cells(df, values, truncate).items()]
    kept = df.where(F.col("cirurgiao").isNotNull())
    return kept.groupBy("cirurgiao").agg(F.count("prontuario").alias("Total"), *by_type).orderBy(F.desc("Total"), "cirurgiao")


def ranking_map(df: DataFrame, order: str = ORDER) -> DataFrame:
    """The ranking with its counts per type in a map, for any number of types: cirurgiao, Total, tipos.

    Entries stand in the types' order of first appearance in `df`; types that are NULL or empty, and pairs that do not
    occur, have no entry (Python's collect loses the order of entries, posexplode keeps it). Per pair of surgeon and type one row is shuffled, and no list of types is needed.
    """
    kept = df.where(F.col("cirurgiao").isNotNull())
    pairs = df.groupBy("cirurgiao", "tipo_procedimento").agg(F.count("prontuario").alias("n"), F.min(ordered(df, order)).alias("at"))
    typed = F.coalesce(F.col("tipo_procedimento"), F.lit("")) != ""
    seen = pairs.where(typed).groupBy("tipo_procedimento").agg(F.min("at").alias("seen"))
    entries = pairs.where(typed & F.col("cirurgiao").isNotNull()).join(seen, "tipo_procedimento")
    listed = F.array_sort(F.collect_list(F.struct("seen", "tipo_procedimento", "n")))
    as_map = F.map_from_entries(F.transform(listed, lambda x: F.struct(x["tipo_procedimento"], x["n"])))
    by_type = entries.groupBy("cirurgiao").agg(as_map.alias("tipos"))
    total = kept.groupBy("cirurgiao").agg(F.count("prontuario").alias("Total"))
    none = F.create_map().cast("map<string,bigint>")
    return total.join(by_type, "cirurgiao", "left").select("cirurgiao", "Total", F.coalesce("tipos", none).alias("tipos")).orderBy(F.desc("Total"), "cirurgiao")


def ranking_grid(df: DataFrame) -> DataFrame:
    """The ranking as shown: measures, dates as text, a column per type (headers cut), display names."""
    by_type = cells(df, truncate=True) if has(df, "tipo_procedimento") else {}
    kept = df.where(F.col("cirurgiao").isNotNull())
    ranked = kept.groupBy("cirurgiao").agg(*measures(), *(c.alias(f"_t_{name}") for name, c in by_type.items())).orderBy(F.desc("Total"), "cirurgiao")
    day = lambda c: F.date_format(c, "dd/MM/yyyy") if c in ("Primeiro", "Ultimo") else F.col(c)
    return ranked.select(*(day(c).alias(n) for c, n in RANKING_COLUMNS.items()), *(F.col(f"`_t_{name}`").alias(name) for name in by_type))
