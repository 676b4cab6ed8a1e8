"""Column contract of the fact table and the research sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names, display names and placeholders that results carry.
DATE_COLUMNS = ("dt_nascimento", "data_inicio", "data_fim", "data_atendimento", "data_alta")
RECORD_COLUMNS = {
    "tipo_procedimento": "Tipo",
    "prontuario": "Prontuário",
    "nome": "Nome",
    "cpf": "CPF",
    "dt_nascimento": "Dt Nasc.",
    "idade": "Idade",
    "sexo": "Sexo",
    "municipio": "Município",
    "tipo_atendimento": "Atendimento",
    "data_inicio": "Início",
    "data_fim": "Fim",
    "duracao_minutos": "Dur.(min)",
    "lateralidade": "Lado",
    "cirurgiao": "Cirurgião",
    "anestesista": "Anestesista",
    "centro_sala": "Sala",
}
RANKING_COLUMNS = {
    "cirurgiao": "Cirurgião",
    "Total": "Total",
    "Pacientes": "Pacientes únicos",
    "Dur_media": "Duração média (min)",
    "Primeiro": "Primeiro proc.",
    "Ultimo": "Último proc.",
}
REPEATED_COLUMNS = {"cpf": "CPF", "nome": "Nome", "Total": "Procedimentos", "Tipos": "Tipos realizados", "Prontuario": "Prontuário"}
COUNT_LABELS = {"tipo_procedimento": "Tipo", "lateralidade": "Lado", "cirurgiao": "Cirurgião", "tipo_atendimento": "Tipo", "municipio": "Município"}
CHIP_LABELS = {"tipo_procedimento": "Tipo", "cirurgiao": "Cirurgião", "municipio": "Município", "lateralidade": "Lado", "tipo_atendimento": "Atendimento"}
OTHER_TYPE = "Outro"
SHEET_RULE = "─" * 52
SHEET_HEAD = (
    "Nome      : %s\n"
    "Prontuário: %s   CPF: %s\n"
    "Nasc.     : %s   Idade: %s   Sexo: %s\n"
    "Município : %s\n"
    f"{SHEET_RULE}\n"
    "PROCEDIMENTOS REALIZADOS (%d)\n"
    f"{SHEET_RULE}\n"
)
SHEET_ITEM = (
    "\n%d. %s\n"
    "   Data: %s  Lado: %s  Duração: %s min\n"
    "   Cirurgião: %s\n"
    "   Internação: %s   Alta: %s\n"
)
#: What the loaders add: the place of a row in its source, for records and for the research sheet.
ORDER, ROW = "registro_id", "_row"
#: Folder column of tables kept by month.
MONTH = "mes_inicio"
EDITABLE = ("IMC", "Tab", "ID")
MISSING_TEXT = "—"
NO_MONTH = "NaT"

FACT = T.StructType(
    [
        T.StructField("registro_id", T.LongType(), False),
        *(
            T.StructField(name, T.StringType())
            for name in ("tipo_procedimento", "prontuario", "nome", "cpf", "sexo", "municipio", "tipo_atendimento", "lateralidade", "cirurgiao", "anestesista", "centro_sala")
        ),
        T.StructField("idade", T.IntegerType()),
        T.StructField("duracao_minutos", T.IntegerType()),
        *(T.StructField(name, T.TimestampNTZType()) for name in DATE_COLUMNS),
    ]
)


class SchemaError(ValueError):
    """The input breaks the column contract."""


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def ordered(df: DataFrame, name: str = ORDER) -> str:
    """The column that holds the rows' order. The loaders add it; a frame from elsewhere must bring one."""
    if not has(df, name):
        raise SchemaError(f"rows have no order: no column {name} (the loaders add it)")
    return name


def checked(df: DataFrame) -> DataFrame:
    """Reject what Spark would resolve ambiguously or print wrongly.

    Case variants of one column name clash in Spark, and identifiers held as
    floating point lose their digits when turned into text.
    """
    folded = [c.lower() for c in df.columns]
    clash = sorted({c for c in folded if folded.count(c) > 1})
    if clash:
        raise SchemaError(f"column names differ only in case: {', '.join(clash)}")
    floating = [c for c, kind in df.dtypes if c in ("cpf", "prontuario") and kind in ("double", "float")]
    if floating:
        raise SchemaError(f"identifiers must not be floating point: {', '.join(floating)}")
    return df
