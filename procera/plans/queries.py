"""Registered queries over the adapter view, each beside its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procera.functions.scalars import first_token, thousands
from procera.operators import overview, patients, research, surgeons
from procera.operators.filters import PATIENT_SEARCH, RECORD_SEARCH, Filters, patient_search, search
from procera.operators.export import to_csv
from procera.operators.monthly_state import MonthlyState
from procera.operators.ordinals import placed
from procera.operators.search_index import SearchIndex
from procera.schema import MONTH, ORDER
from procera.sources.adapter import WITH_REGISTROS, registros, registros_by_place
from procera.sources.by_month import save_by_month
from procera.sources.loading import load_parquet, normalise_dates, rejected_dates
from procera.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PERIOD = (dt.date(1995, 1, 1), dt.date(1996, 6, 30))
TYPES = ("1-URGENT", "2-HIGH")
ALL_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: A selection of each filter, all of them present in the test tables.
SELECTED = {
    "tipo_procedimento": TYPES,
    "cirurgiao": ("small ring ECONOMY", "red widget ECONOMY", "blue bolt SMALL"),
    "municipio": tuple(f"NATION_{i}" for i in range(15)),
    "lateralidade": ("O", "F"),
    "tipo_atendimento": ("BUILDING", "MACHINERY"),
}


def one_of(column: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in SELECTED[column])})"


def register(name: str, oracle: str, rows: Query = registros) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    def add(build: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(rows(spark, sf_dir))
        ORACLES[name] = f"{WITH_REGISTROS} {oracle}"
        return build

    return add


register_by_place = partial(register, rows=registros_by_place)


register("scan", "SELECT * FROM registros")(lambda df: df)
register(
    "record_view",
    """SELECT tipo_procedimento AS "Tipo", prontuario AS "Prontuário", nome AS "Nome", cpf AS "CPF", dt_nascimento AS "Dt Nasc.", idade AS "Idade", sexo AS "Sexo",
    municipio AS "Município", tipo_atendimento AS "Atendimento", data_inicio AS "Início", data_fim AS "Fim", duracao_minutos AS "Dur.(min)", lateralidade AS "Lado",
    cirurgiao AS "Cirurgião", anestesista AS "Anestesista", centro_sala AS "Sala" FROM registros""",
)(overview.record_view)
register(
    "record_export",
    """SELECT tipo_procedimento, prontuario, nome, cpf, dt_nascimento, idade, sexo, municipio, tipo_atendimento, data_inicio, data_fim, duracao_minutos, lateralidade,
    cirurgiao, anestesista, centro_sala FROM registros""",
)(lambda df: overview.record_view(df, display=False))


@register(
    "parse_dates",
    """, raw AS (SELECT registro_id, CASE registro_id % 4 WHEN 0 THEN strftime(data_inicio, '%d/%m/%Y')
      WHEN 1 THEN strftime(data_inicio, '%Y-%m-%d') WHEN 2 THEN strftime(data_inicio, '%d/%m/%Y %H:%M') ELSE 'junk' END AS txt FROM registros)
    SELECT registro_id, coalesce(try_strptime(txt, '%d/%m/%Y'), try_strptime(txt, '%d/%m/%Y %H:%M'), try_strptime(txt, '%Y-%m-%d')) AS data_inicio FROM raw""",
)
def parse_dates(df: DataFrame) -> DataFrame:
    at, kind = F.col("data_inicio"), F.col("registro_id") % 4
    text = F.when(kind == 0, F.date_format(at, "dd/MM/yyyy")).when(kind == 1, F.date_format(at, "yyyy-MM-dd")).when(kind == 2, F.date_format(at, "dd/MM/yyyy HH:mm")).otherwise("junk")
    return normalise_dates(df.select("registro_id", text.alias("data_inicio")))


_PATTERNS = ["%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%Y-%m-%dT%H:%M:%S", "%d-%m-%Y", "%d-%m-%Y %H:%M:%S", "%d/%m/%y", "%d/%m/%y %H:%M"]
_RAW = (
    ", raw AS (SELECT registro_id, CASE registro_id % 11 "
    + " ".join(f"WHEN {i} THEN strftime(dt_nascimento, '{p}')" for i, p in enumerate(_PATTERNS))
    + " WHEN 8 THEN '31/02/' || (registro_id % 5) WHEN 9 THEN ' ' ELSE 'sem data ' || (registro_id % 3) END AS txt FROM registros)"
)


def raw_dates(df: DataFrame) -> DataFrame:
    """Birth dates as texts of every accepted form, and texts that are none."""
    java = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "T": "'T'"}
    at, kind = F.col("dt_nascimento"), F.col("registro_id") % 11
    text = F.when(kind == 8, F.concat(F.lit("31/02/"), F.col("registro_id") % 5)).when(kind == 9, F.lit(" ")).when(kind == 10, F.concat(F.lit("sem data "), F.col("registro_id") % 3))
    for i, pattern in enumerate(_PATTERNS):
        for a, b in java.items():
            pattern = pattern.replace(a, b)
        text = text.when(kind == i, F.date_format(at, pattern))
    return df.select("registro_id", text.alias("dt_nascimento"))


_FITS = f"coalesce({', '.join(f"try_strptime(txt, '{p}')" for p in sorted(_PATTERNS, key=lambda p: "%y" not in p))})"  # first: %Y takes two digits as well
register("parse_dates_all", f"{_RAW} SELECT registro_id, {_FITS} AS dt_nascimento FROM raw")(lambda df: normalise_dates(raw_dates(df)))
register("rejected_dates", f"{_RAW} SELECT 'dt_nascimento' AS coluna, txt AS texto, count(*) AS linhas FROM raw WHERE trim(txt) <> '' AND {_FITS} IS NULL GROUP BY txt")(
    lambda df: rejected_dates(raw_dates(df))
)
for _c in SELECTED:
    register(f"isin_{_c}", f"SELECT * FROM registros WHERE {one_of(_c)}")(Filters(**{_c: SELECTED[_c]}).apply)
register("isin", "SELECT * FROM registros WHERE " + " AND ".join(map(one_of, SELECTED)))(Filters(**SELECTED).apply)
register("period", "SELECT * FROM registros WHERE data_inicio >= TIMESTAMP '1995-01-01' AND data_inicio <= TIMESTAMP '1996-06-30'")(Filters(period=PERIOD).apply)
register("period_end_of_day", "SELECT * FROM registros WHERE data_inicio >= TIMESTAMP '1995-01-01' AND data_inicio < TIMESTAMP '1996-07-01'")(Filters(period=PERIOD, end_of_day=True).apply)


register("filters_all", "SELECT * FROM registros WHERE " + " AND ".join(map(one_of, SELECTED)) + " AND data_inicio >= TIMESTAMP '1995-01-01' AND data_inicio <= TIMESTAMP '2000-06-30'")(
    Filters(**SELECTED, period=(dt.date(1995, 1, 1), dt.date(2000, 6, 30))).apply
)
_RE_ANY = " OR ".join(f"regexp_matches(upper(coalesce({c}, 'None')), '{{0}}')" for c in ("nome", "prontuario", "cpf", "cirurgiao", "municipio"))
_RE_PATIENT = " OR ".join(f"regexp_matches(upper(coalesce({c}, 'None')), '{{0}}')" for c in ("nome", "prontuario", "cpf"))
register("search", f"SELECT * FROM registros WHERE {_RE_ANY.format('0012|NATION.1[0-2]$')}")(lambda df: search(df, "0012|nation.1[0-2]$"))
register("search_literal", "SELECT * FROM registros WHERE " + " OR ".join(f"contains(upper({c}), '0012')" for c in ("nome", "prontuario", "cpf", "cirurgiao", "municipio")))(lambda df: search(df, "0012", literal=True))
register("patient_search", f"SELECT * FROM registros WHERE {_RE_PATIENT.format('NONE|#0000001')}")(lambda df: patient_search(df, "none|#0000001"))


def indexed(term: str, columns: tuple[str, ...] = RECORD_SEARCH, literal: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Search by an index that is built over all rows first."""

    def run(df: DataFrame) -> DataFrame:
        return SearchIndex(df.sparkSession, new_path(df.sparkSession, "search-index")).build(df).search(df, term, columns, literal)

    return run


register("search_index", f"SELECT * FROM registros WHERE {_RE_ANY.format('0012|NATION.1[0-2]$')}")(indexed("0012|nation.1[0-2]$"))
register("search_index_null", f"SELECT * FROM registros WHERE {_RE_ANY.format('NON[EF]|(WIDGET|BOLT) (SM|EC)+')}")(indexed("non[ef]|(widget|bolt) (sm|ec)+"))
register("search_index_literal", "SELECT * FROM registros WHERE " + " OR ".join(f"contains(upper({c}), '0012')" for c in RECORD_SEARCH))(indexed("0012", literal=True))
register("patient_search_index", f"SELECT * FROM registros WHERE {_RE_PATIENT.format('NONE|#0000001')}")(indexed("none|#0000001", PATIENT_SEARCH))


@register("period_by_month", "SELECT * FROM registros WHERE data_inicio >= TIMESTAMP '1995-01-01' AND data_inicio <= TIMESTAMP '1996-06-30'")
def period_by_month(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "by-month")
    save_by_month(df, path)
    return Filters(period=PERIOD).apply(load_parquet(df.sparkSession, path)).drop(MONTH)


register(
    "domains",
    " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS coluna, {c} AS valor FROM registros WHERE {c} IS NOT NULL" for c in SELECTED),
)(overview.domains)
register("distinct", "SELECT DISTINCT cirurgiao FROM registros WHERE cirurgiao IS NOT NULL")(lambda df: overview.domain(df, "cirurgiao"))
for _c in ("tipo_procedimento", "municipio", "lateralidade", "tipo_atendimento"):
    register(f"distinct_{_c}", f"SELECT DISTINCT {_c} FROM registros WHERE {_c} IS NOT NULL")(lambda df, c=_c: overview.domain(df, c))
register("minmax", "SELECT min(data_inicio) AS minimo, max(data_inicio) AS maximo FROM registros")(overview.bounds)
register(
    "kpi",
    "SELECT count(*) AS total, count(DISTINCT cpf) AS pacientes, count(DISTINCT cirurgiao) AS cirurgioes, CAST(trunc(coalesce(avg(duracao_minutos), 0)) AS INTEGER) AS duracao_media FROM registros",
)(overview.kpi)


@register("kpi_by_month", ORACLES["kpi"].removeprefix(WITH_REGISTROS))
def kpi_by_month(df: DataFrame) -> DataFrame:
    """The state is built in two steps, as months arrive."""
    state = MonthlyState(df.sparkSession, new_path(df.sparkSession, "monthly-state"))
    early = F.col("data_inicio") < F.lit("1995-01-01").cast("timestamp_ntz")
    state.add(df.where(early))
    state.add(df.where(~early | F.col("data_inicio").isNull()))
    return state.kpi()


@register("kpi_of_months", ORACLES["kpi"].removeprefix(WITH_REGISTROS) + " WHERE strftime(data_inicio, '%Y-%m') IN ('1995-02', '1996-11')")
def kpi_of_months(df: DataFrame) -> DataFrame:
    state = MonthlyState(df.sparkSession, new_path(df.sparkSession, "monthly-state"))
    state.add(df)
    return state.kpi(["1995-02", "1996-11"])


for _c, _label in (("tipo_procedimento", "Tipo"), ("lateralidade", "Lado"), ("tipo_atendimento", "Tipo")):
    register(f"vc_{_c}", f"SELECT {_c} AS \"{_label}\", count(*) AS Total FROM registros WHERE {_c} IS NOT NULL GROUP BY 1")(lambda df, c=_c: overview.value_counts(df, c))
register(
    "top10",
    """, t AS (SELECT cirurgiao, count(*) AS Total FROM registros WHERE cirurgiao IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT cirurgiao AS "Cirurgião", Total, array_to_string(list_slice(regexp_split_to_array(trim(cirurgiao), '\\s+'), 1, 2), ' ') AS "Nome" FROM t""",
)(overview.top_surgeons)
register("top10_municipio", 'SELECT municipio AS "Município", count(*) AS Total FROM registros WHERE municipio IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')(lambda df: overview.top(df, "municipio"))
for _n, _c, _label in (("share_lateralidade", "lateralidade", "Lado"), ("share_atendimento", "tipo_atendimento", "Tipo")):
    register(_n, f"SELECT {_c} AS \"{_label}\", count(*) AS Total, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM registros WHERE {_c} IS NOT NULL GROUP BY 1")(lambda df, c=_c: overview.share(df, c))
register("mensal", "SELECT strftime(data_inicio, '%Y-%m') AS mes, tipo_procedimento, count(*) AS Total FROM registros WHERE data_inicio IS NOT NULL AND tipo_procedimento IS NOT NULL GROUP BY 1, 2")(overview.monthly)


@register(
    "cir_mensal",
    """, c AS (SELECT min(cirurgiao) AS c FROM registros)
    SELECT coalesce(strftime(data_inicio, '%Y-%m'), 'NaT') AS mes, count(*) AS Total FROM registros, c WHERE cirurgiao = c.c GROUP BY 1""",
)
def cir_mensal(df: DataFrame) -> DataFrame:
    return overview.monthly_of_surgeon(df, df.agg(F.min("cirurgiao")).first()[0])


register("first_token", "SELECT registro_id, regexp_split_to_array(trim(cirurgiao), '\\s+')[1] AS primeiro FROM registros")(lambda df: df.select("registro_id", first_token(F.col("cirurgiao")).alias("primeiro")))
register(
    "ranking",
    """SELECT cirurgiao, count(prontuario) AS Total, count(DISTINCT cpf) AS Pacientes, CAST(trunc(coalesce(avg(duracao_minutos), 0)) AS INTEGER) AS Dur_media,
    min(data_inicio) AS Primeiro, max(data_inicio) AS Ultimo FROM registros WHERE cirurgiao IS NOT NULL GROUP BY 1""",
)(surgeons.ranking)
register(
    "ranking_map",
    """, f AS (SELECT tipo_procedimento AS tipo, min(registro_id) AS p FROM registros WHERE tipo_procedimento IS NOT NULL GROUP BY 1),
    g AS (SELECT cirurgiao, tipo_procedimento AS tipo, count(prontuario) AS n FROM registros WHERE cirurgiao IS NOT NULL AND tipo_procedimento IS NOT NULL GROUP BY 1, 2)
    SELECT cirurgiao, row_number() OVER (PARTITION BY cirurgiao ORDER BY p) AS coluna, tipo, n FROM g JOIN f USING (tipo)""",
)(lambda df: surgeons.ranking_map(df).select("cirurgiao", F.posexplode("tipos").alias("at", "tipo", "n")).select("cirurgiao", (F.col("at") + 1).cast("bigint").alias("coluna"), "tipo", "n"))
register(
    "ranking_pivot",
    "SELECT cirurgiao, count(prontuario) AS Total, "
    + ", ".join(f"""CASE WHEN count(*) FILTER (WHERE tipo_procedimento = '{v}') > 0 THEN count(prontuario) FILTER (WHERE tipo_procedimento = '{v}') END AS "{v}\"""" for v in ALL_TYPES)
    + " FROM registros WHERE cirurgiao IS NOT NULL GROUP BY 1",
)(lambda df: surgeons.ranking_pivot(df, ALL_TYPES))
_RANKING_GRID = (
    """SELECT cirurgiao AS "Cirurgião", count(prontuario) AS "Total", count(DISTINCT cpf) AS "Pacientes únicos", CAST(trunc(coalesce(avg(duracao_minutos), 0)) AS INTEGER) AS "Duração média (min)",
    strftime(min(data_inicio), '%d/%m/%Y') AS "Primeiro proc.", strftime(max(data_inicio), '%d/%m/%Y') AS "Último proc.", NULL::BIGINT AS "Outro", """
    + ", ".join(f"""CASE WHEN count(*) FILTER (WHERE tipo_procedimento = '{v}') > 0 THEN count(prontuario) FILTER (WHERE tipo_procedimento = '{v}') END AS "{v[:12]}\"""" for v in ALL_TYPES)
    + " FROM registros WHERE cirurgiao IS NOT NULL GROUP BY 1"
)
register("ranking_grid", _RANKING_GRID)(surgeons.ranking_grid)
_MULTI = """SELECT cpf AS "CPF", nome AS "Nome", count(prontuario) AS "Procedimentos", coalesce(string_agg(DISTINCT tipo_procedimento, ' | ' ORDER BY tipo_procedimento), '') AS "Tipos realizados",
    arg_min(prontuario, registro_id) FILTER (WHERE prontuario IS NOT NULL) AS "Prontuário"
    FROM registros WHERE cpf IS NOT NULL AND nome IS NOT NULL GROUP BY 1, 2 HAVING count(prontuario) > 1"""
_HISTORY = """SELECT cpf, {0}row_number() OVER (PARTITION BY cpf ORDER BY registro_id) AS ordem, count(*) OVER (PARTITION BY cpf) AS total,
    tipo_procedimento, coalesce(strftime(data_inicio, '%d/%m/%Y'), '—') AS data FROM registros WHERE cpf IS NOT NULL"""
_HEADER = """, r AS (SELECT *, row_number() OVER (PARTITION BY cpf ORDER BY registro_id) AS k, count(*) OVER (PARTITION BY cpf) AS total FROM registros WHERE cpf IS NOT NULL)
    SELECT cpf, nome, prontuario, coalesce(strftime(dt_nascimento, '%d/%m/%Y'), '—') AS nascimento, idade, sexo, municipio, total FROM r WHERE k = 1"""
_ITEMS = """, r AS (SELECT *, row_number() OVER (PARTITION BY cpf ORDER BY registro_id) AS k, count(*) OVER (PARTITION BY cpf) AS n FROM registros WHERE cpf IS NOT NULL),
    l AS (SELECT *, chr(10) || k || '. ' || coalesce(tipo_procedimento, '—') || chr(10)
      || '   Data: ' || coalesce(strftime(data_inicio, '%d/%m/%Y'), '—') || '  Lado: ' || coalesce(lateralidade, '—') || '  Duração: ' || coalesce(duracao_minutos::VARCHAR, '—') || ' min' || chr(10)
      || '   Cirurgião: ' || coalesce(cirurgiao, '—') || chr(10)
      || '   Internação: ' || coalesce(strftime(data_atendimento, '%d/%m/%Y'), '—') || '   Alta: ' || coalesce(strftime(data_alta, '%d/%m/%Y'), '—') || chr(10) AS item,
      CASE WHEN k > 1 THEN '' ELSE 'Nome      : ' || coalesce(nome, '—') || chr(10) || 'Prontuário: ' || coalesce(prontuario, '—') || '   CPF: ' || cpf || chr(10)
      || 'Nasc.     : ' || coalesce(strftime(dt_nascimento, '%d/%m/%Y'), '—') || '   Idade: ' || coalesce(idade::VARCHAR, '—') || '   Sexo: ' || coalesce(sexo, '—') || chr(10)
      || 'Município : ' || coalesce(municipio, '—') || chr(10) || repeat('─', 52) || chr(10)
      || 'PROCEDIMENTOS REALIZADOS (' || n || ')' || chr(10) || repeat('─', 52) || chr(10) END AS head FROM r)"""
_SHEET = _ITEMS + " SELECT cpf, string_agg(head || item, '' ORDER BY k) AS texto FROM l GROUP BY cpf"
#: Procedures in a piece of a sheet, few enough that patients of the test tables have several pieces.
FEW = 4
register("multi", _MULTI)(patients.repeated)
register("ficha", _HISTORY.format("registro_id, "))(patients.history)
register("patient_header", _HEADER)(patients.header)
register("ficha_text", _SHEET)(patients.sheet)
register("ficha_pieces", _ITEMS + f" SELECT cpf, (k - 1) // {FEW} AS peca, string_agg(head || item, '' ORDER BY k) AS texto FROM l GROUP BY 1, 2")(lambda df: patients.sheet_pieces(df, FEW))
# Rows without an identifier: their order is the one of the source.
register_by_place("ranking_grid_by_place", _RANKING_GRID)(surgeons.ranking_grid)
register_by_place("multi_by_place", _MULTI)(patients.repeated)
register_by_place("ficha_by_place", _HISTORY.format(""))(lambda df: patients.history(df).drop(ORDER))
register_by_place("patient_header_by_place", _HEADER)(patients.header)
register_by_place("ficha_text_by_place", _SHEET)(patients.sheet)
register_by_place(
    "first_seen_by_place",
    """, t AS (SELECT tipo_procedimento, min(registro_id) AS p FROM registros WHERE tipo_procedimento IS NOT NULL GROUP BY 1)
    SELECT tipo_procedimento, row_number() OVER (ORDER BY p) AS ordem FROM t""",
)(overview.appearance)


@register(
    "edit_merge",
    """SELECT registro_id AS _row, CASE WHEN registro_id % 10 = 7 THEN NULL ELSE prontuario END AS "ID",
    CASE WHEN registro_id % 5 = 0 THEN 'novo' || registro_id ELSE CAST(duracao_minutos AS VARCHAR) END AS "IMC", lateralidade AS "Tab", nome FROM registros""",
)
def edit_merge(df: DataFrame) -> DataFrame:
    row = F.col("registro_id")
    sheet = df.select(row.alias("_row"), F.col("prontuario").alias("ID"), F.col("duracao_minutos").cast("string").alias("IMC"), F.col("lateralidade").alias("Tab"), "nome")
    new = df.where(row % 5 == 0).select(row.alias("_row"), F.lit("IMC").alias("col"), F.concat(F.lit("novo"), row.cast("string")).alias("val"))
    gone = df.where(row % 10 == 7).select(row.alias("_row"), F.lit("ID").alias("col"), F.lit(None).cast("string").alias("val"))
    return research.merge_edits(sheet, new.unionByName(gone), check=False)


# Order as it is shown: positions in the sorted results.
register(
    "order_value_counts",
    """, t AS (SELECT cirurgiao, count(*) AS Total FROM registros WHERE cirurgiao IS NOT NULL GROUP BY 1)
    SELECT cirurgiao AS "Cirurgião", Total, row_number() OVER (ORDER BY Total DESC, cirurgiao) AS posicao FROM t""",
)(lambda df: placed(overview.value_counts(df, "cirurgiao")))
register(
    "order_ranking",
    """, t AS (SELECT cirurgiao, count(prontuario) AS Total FROM registros WHERE cirurgiao IS NOT NULL GROUP BY 1)
    SELECT cirurgiao, Total, row_number() OVER (ORDER BY Total DESC, cirurgiao) AS posicao FROM t""",
)(lambda df: placed(surgeons.ranking(df)).select("cirurgiao", "Total", "posicao"))
register(
    "order_multi",
    """, t AS (SELECT cpf, nome, count(prontuario) AS n FROM registros WHERE cpf IS NOT NULL AND nome IS NOT NULL GROUP BY 1, 2 HAVING count(prontuario) > 1)
    SELECT cpf AS "CPF", nome AS "Nome", row_number() OVER (ORDER BY n DESC, cpf, nome) AS posicao FROM t""",
)(lambda df: placed(patients.repeated(df)).select("CPF", "Nome", "posicao"))
register(
    "order_domain", "SELECT valor, row_number() OVER (ORDER BY valor) AS posicao FROM (SELECT DISTINCT municipio AS valor FROM registros WHERE municipio IS NOT NULL)"
)(lambda df: placed(overview.domain(df, "municipio").withColumnRenamed("municipio", "valor")))


@register("save_over", "SELECT * REPLACE ('novo' AS lateralidade) FROM registros WHERE lateralidade = 'O' AND registro_id % 2 = 0")
def save_over(df: DataFrame) -> DataFrame:
    """Saved, read, changed, and saved over what was read."""
    path = new_path(df.sparkSession, "saved")
    research.save_over(df.where("lateralidade = 'O'"), path)
    research.save_over(load_parquet(df.sparkSession, path).where("registro_id % 2 = 0").withColumn("lateralidade", F.lit("novo")), path)
    return load_parquet(df.sparkSession, path)


_PLAIN = "registro_id tipo_procedimento prontuario nome cpf idade sexo municipio tipo_atendimento duracao_minutos lateralidade cirurgiao anestesista centro_sala".split()


@register("export_patient", f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _PLAIN)} FROM registros WHERE cpf = (SELECT min(cpf) FROM registros)")
def export_patient(df: DataFrame) -> DataFrame:
    """All columns of one patient as exported, read back as text (dates are left out: their form in a file is the writer's)."""
    path = new_path(df.sparkSession, "export")
    to_csv(patients.rows_of(df, df.agg(F.min("cpf")).first()[0]), path)
    return df.sparkSession.read.option("header", True).csv(path).select(_PLAIN)


register("fmt", "SELECT format('{:,}', count(*)) AS total FROM registros")(lambda df: df.agg(thousands(F.count("*")).alias("total")))
