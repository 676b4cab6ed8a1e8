"""Patient lookup, numbered histories, text sheets, repeated procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.functions.scalars import day_text
from procera.operators.ordinals import numbered
from procera.schema import MISSING_TEXT, ORDER, REPEATED_COLUMNS, SHEET_HEAD, SHEET_ITEM, has, ordered

#: Procedures in one piece of a sheet's text.
PIECE = 1000


def or_missing(df: DataFrame, name: str) -> F.Column:
    """The column as text, or the placeholder where the column itself is absent."""
    return F.col(name).cast("string") if has(df, name) else F.lit(MISSING_TEXT)


def key_of(df: DataFrame) -> str:
    return "cpf" if has(df, "cpf") else "prontuario"


def history(df: DataFrame, order: str = ORDER) -> DataFrame:
    """Every procedure of every identified patient, numbered within the patient."""
    key = key_of(df)
    return numbered(df, key, order).select(
        key,
        order,
        "ordem",
        "total",
        or_missing(df, "tipo_procedimento").alias("tipo_procedimento"),
        shown_day(df, "data_inicio").alias("data"),
    )


def header(df: DataFrame, order: str = ORDER) -> DataFrame:
    """The first record of each patient gives the header fields; the birth date is text, an absent column reads as the placeholder."""
    key = key_of(df)
    own = lambda c: F.col(c) if has(df, c) else F.lit(MISSING_TEXT)
    fields = {c: own(c) for c in ("nome", "prontuario", "idade", "sexo", "municipio")} | {"nascimento": shown_day(df, "dt_nascimento")}
    fields = {name: c for name, c in fields.items() if name != key}
    first = F.min_by(F.struct(*(c.alias(name) for name, c in fields.items())), ordered(df, order))
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_h"), F.count("*").alias("total"))
    return grouped.select(key, *(F.col(f"_h.{c}").alias(c) for c in fields), "total")


def shown(df: DataFrame, name: str) -> F.Column:
    """The column as text; the placeholder for NULL and where the column itself is absent."""
    return F.coalesce(or_missing(df, name), F.lit(MISSING_TEXT))


def shown_day(df: DataFrame, name: str) -> F.Column:
    return day_text(F.col(name)) if has(df, name) else F.lit(MISSING_TEXT)


def sheet_pieces(df: DataFrame, size: int = PIECE, order: str = ORDER) -> DataFrame:
    """A patient's sheet in pieces of at most `size` procedures: key, peca (from 0), texto.

    Piece 0 begins with the header block from the first record; pieces in order are the sheet. No patient's text has to fit a task.
    """
    key = key_of(df)
    item = F.format_string(
        SHEET_ITEM,
        F.col("_ordem"),
        shown(df, "tipo_procedimento"),
        shown_day(df, "data_inicio"),
        shown(df, "lateralidade"),
        shown(df, "duracao_minutos"),
        shown(df, "cirurgiao"),
        shown_day(df, "data_atendimento"),
        shown_day(df, "data_alta"),
    )
    code = (F.when(F.col(key) == "", MISSING_TEXT).otherwise(F.col(key))) if key == "cpf" else F.col(key)
    head = F.format_string(
        SHEET_HEAD, *(shown(df, c) for c in ("nome", "prontuario")), code, shown_day(df, "dt_nascimento"), *(shown(df, c) for c in ("idade", "sexo", "municipio")), F.col("_total")
    )
    text = F.when(F.col("_ordem") == 1, F.concat(head, item)).otherwise(item)
    piece = F.floor((F.col("_ordem") - 1) / size).alias("peca")
    rows = numbered(df, key, order, "_ordem", "_total").select(key, piece, F.struct("_ordem", text.alias("item")).alias("_i"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_i")), lambda x: x["item"]), "")
    return rows.groupBy(key, "peca").agg(joined.alias("texto"))


def sheet(df: DataFrame, order: str = ORDER) -> DataFrame:
    """One text per patient: a header block from the first record, then a numbered block per procedure. For patients whose text fits a row."""
    key = key_of(df)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("peca", "texto"))), lambda x: x["texto"]), "")
    return sheet_pieces(df, order=order).groupBy(key).agg(joined.alias("texto"))


def rows_of(df: DataFrame, value: str, order: str = ORDER) -> DataFrame:
    """All columns of one patient's records, in record order: what the patient export writes."""
    return df.where(F.col(key_of(df)) == value).orderBy(ordered(df, order))


def repeated(df: DataFrame, more_than: int = 1, order: str = ORDER) -> DataFrame:
    """Patients with several procedures; types sorted and joined, first non-null chart number."""
    kept = df.where(F.col("cpf").isNotNull() & F.col("nome").isNotNull())
    grouped = kept.groupBy("cpf", "nome").agg(
        F.count("prontuario").alias("Total"),
        F.array_join(F.array_sort(F.collect_set("tipo_procedimento")), " | ").alias("Tipos"),
        F.min_by("prontuario", F.when(F.col("prontuario").isNotNull(), F.col(ordered(df, order)))).alias("Prontuario"),
    )
    return grouped.where(F.col("Total") > more_than).orderBy(F.desc("Total"), "cpf", "nome").withColumnsRenamed(REPEATED_COLUMNS)
