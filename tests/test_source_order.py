"""Rows get their order from the source: every record operator runs on a table of the contract's 18 columns."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from procera.operators import filters, ordinals, overview, patients, research, surgeons
from procera.schema import FACT, SchemaError
from procera.sources import loading
from procera.sources.sqlite import SourceError, relation_names, table_names

COLUMNS = [f.name for f in FACT if f.name != "registro_id"]
ROWS = [
    # cpf, nome, prontuario, tipo, cirurgiao, inicio, nascimento
    ("2", "Bia", None, "B", "X Y", "02/01/2024", None),
    ("1", "Ana", "p1", "A", "X Y", "2024-01-01", "05/03/1970"),
    ("2", "Bia", "p9", "A", "Z", None, "06/03/1980"),
    ("1", "Ana", "p2", None, "X Y", "01/02/2024", "05/03/1971"),
    (None, "Sem", "p3", "C", "Z", "03/01/2024", None),
    ("2", "Bia", "p4", "C", "X Y", "04/01/2024", None),
]


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('db')}/banco.db"
    named = ("cpf", "nome", "prontuario", "tipo_procedimento", "cirurgiao", "data_inicio", "dt_nascimento")
    ddl = ", ".join(f"{c} {'INTEGER' if c in ('idade', 'duracao_minutos') else 'TEXT'}" for c in COLUMNS)
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE fatos ({ddl})")
        db.executemany(f"INSERT INTO fatos ({', '.join(named)}) VALUES (?, ?, ?, ?, ?, ?, ?)", ROWS)
        db.execute("CREATE VIEW visao AS SELECT * FROM fatos WHERE cpf IS NOT NULL")
        db.execute("CREATE TABLE sem_rowid (cpf TEXT PRIMARY KEY, nome TEXT) WITHOUT ROWID")
        db.executemany("INSERT INTO sem_rowid VALUES (?, ?)", [("c", "3"), ("a", "1"), ("b", "2")])
        db.execute("CREATE TABLE sombra (rowid TEXT, oid TEXT)")
        db.executemany("INSERT INTO sombra VALUES (?, ?)", [("r1", "o1"), ("r2", "o2")])
        db.execute("CREATE TABLE errada (n INTEGER)")
        db.execute("INSERT INTO errada VALUES ('texto')")
        db.execute("CREATE TABLE pesquisa_clinica (ID TEXT, IMC TEXT, nome TEXT)")
        db.executemany("INSERT INTO pesquisa_clinica VALUES (?, ?, ?)", [(str(i), None, f"n{i}") for i in range(5)])
    return path


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_order_is_the_rowid(spark, base):
    df = loading.load_sqlite(spark, base, "fatos")
    assert df.columns == ["registro_id", *COLUMNS]
    assert listed(df.orderBy("registro_id").select("registro_id", "nome")) == [(i + 1, r[1]) for i, r in enumerate(ROWS)]


def test_every_record_operator_runs(spark, base):
    df = loading.load_sqlite(spark, base, "fatos")
    assert surgeons.ranking_grid(df).columns[-4:] == ["B", "A", "Outro", "C"]
    assert listed(surgeons.ranking_grid(df).select("Cirurgião", "Total", "B", "A", "C")) == [("X Y", 3, 0, 1, 1), ("Z", 2, None, 1, 1)]
    assert surgeons.ranking_pivot(df).count() == surgeons.ranking(df).count() == 2
    assert sorted(listed(patients.history(df).select("cpf", "ordem", "total", "data"))) == [
        ("1", 1, 2, "01/01/2024"), ("1", 2, 2, "01/02/2024"), ("2", 1, 3, "02/01/2024"), ("2", 2, 3, "—"), ("2", 3, 3, "04/01/2024"),
    ]
    assert sorted(listed(patients.header(df).select("cpf", "prontuario", "nascimento", "total"))) == [("1", "p1", "05/03/1970", 2), ("2", None, "—", 3)]
    assert listed(patients.repeated(df)) == [("1", "Ana", 2, "A", "p1"), ("2", "Bia", 2, "A | B | C", "p9")]
    texts = dict(listed(patients.sheet(df)))
    assert texts["2"].startswith("Nome      : Bia\nProntuário: —   CPF: 2\n") and texts["2"].index("1. B") < texts["2"].index("2. A") < texts["2"].index("3. C")
    assert [r.prontuario for r in patients.rows_of(df, "2").collect()] == [None, "p9", "p4"]
    assert overview.record_view(df).count() == 6 and overview.kpi(df).first().total == 6
    assert filters.search(df, "bia").count() == 3 and filters.patient_search(df, "p9").count() == 1
    assert listed(overview.appearance(df)) == [("B", 1), ("A", 2), ("C", 3)]


def test_absent_columns_read_as_placeholders(spark, base):
    bare = loading.load_sqlite(spark, base, "fatos").select("registro_id", "cpf")
    assert {r.data for r in patients.history(bare).collect()} == {"—"}
    assert {tuple(r)[1:7] for r in patients.header(bare).collect()} == {("—",) * 6}
    assert patients.sheet(bare).count() == 2


def test_views_and_tables_without_rowid(spark, base):
    view = loading.load_sqlite(spark, base, "visao")
    assert [r.nome for r in view.orderBy("registro_id").collect()] == ["Bia", "Ana", "Bia", "Ana", "Bia"]
    assert listed(loading.load_sqlite(spark, base, "sem_rowid").orderBy("registro_id")) == [(1, "a", "1"), (2, "b", "2"), (3, "c", "3")]
    assert listed(loading.load_sqlite(spark, base, "sombra").orderBy("registro_id")) == [(1, "r1", "o1"), (2, "r2", "o2")]
    assert "visao" in relation_names(base) and "visao" not in table_names(base)


def test_splits_keep_the_order(spark, base):
    read = lambda rows: spark.read.format("sqlite_table").options(path=base, table="fatos", order="registro_id", rows=rows).load()
    loading.load_sqlite(spark, base, "fatos")  # registers the format
    assert read(2).rdd.getNumPartitions() == 3
    assert sorted(listed(read(2)), key=str) == sorted(listed(read(100)), key=str)


def test_unreadable_values_are_told(spark, base):
    with pytest.raises(Exception, match="column n of errada is declared bigint"):
        loading.load_sqlite(spark, base, "errada").collect()
    with pytest.raises(SourceError):
        from procera.sources.sqlite import columns

        columns(base, "nada")


def test_edits_find_their_rows(spark, base):
    sheet = loading.load_sqlite(spark, base, "pesquisa_clinica", order="_row")
    edits = spark.createDataFrame([(2, "IMC", "21"), (5, "ID", "novo")], "_row long, col string, val string")
    assert sorted(listed(research.merge_edits(sheet, edits))) == [(1, "0", None, "n0"), (2, "1", "21", "n1"), (3, "2", None, "n2"), (4, "3", None, "n3"), (5, "novo", None, "n4")]


def test_parquet_rows_have_places(spark, tmp_path):
    path = f"{tmp_path}/fatos"
    frame = spark.createDataFrame([(str(i % 3), f"n{i}", "p", "A") for i in range(40)], "cpf string, nome string, prontuario string, tipo_procedimento string")
    frame.coalesce(1).sortWithinPartitions("nome").write.option("maxRecordsPerFile", 7).parquet(path)
    df = loading.load_parquet(spark, path)
    want = sorted(f"n{i}" for i in range(40))
    assert [r.nome for r in df.orderBy("registro_id").collect()] == want
    assert [r.registro_id for r in df.where("nome = 'n30'").collect()] == [r.registro_id for r in df.collect() if r.nome == "n30"]  # pushed filters leave places alone
    numbers = {r.nome: (r.cpf, r.ordem) for r in patients.history(df).join(df.select("registro_id", "nome"), "registro_id").collect()}
    for key in "012":
        mine = [n for n in want if int(n[1:]) % 3 == int(key)]
        assert [numbers[n] for n in mine] == [(key, k + 1) for k in range(len(mine))]
    sheet = loading.with_order(spark.read.parquet(path), "_row").select("_row", "nome", F.lit("x").alias("IMC"))
    row = sheet.where("nome = 'n17'").first()._row
    edits = spark.createDataFrame([(row, "IMC", "19")], "_row struct<file:string,row:bigint>, col string, val string")
    assert sorted(r.nome for r in research.merge_edits(sheet, edits).where("IMC = '19'").collect()) == ["n17"]


def test_frames_without_order_are_refused(spark):
    df = spark.createDataFrame([("1", "a", "p")], "cpf string, nome string, prontuario string")
    with pytest.raises(SchemaError, match="no order"):
        patients.repeated(df)
    with pytest.raises(SchemaError, match="no order"):
        patients.history(df)
    with pytest.raises(SchemaError):
        loading.with_order(df)


def test_large_keys_are_many_tasks(spark):
    """A patient with most of all rows is numbered in many partitions, as row_number would."""
    n = 20_000
    df = spark.range(n, numPartitions=4).select(
        F.xxhash64("id").alias("registro_id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("cpf"), F.lit(1).alias("ordinal")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordinals.numbered(df, "cpf")
        hot = {r[0] for r in spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).where("cpf = 'hot'").select("_ordinal_part").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) >= 5
    want = "row_number() OVER (PARTITION BY cpf ORDER BY registro_id) AS ordem"
    asked = df.where("cpf IS NOT NULL").selectExpr("registro_id", "cpf", want, "count(*) OVER (PARTITION BY cpf) AS total")
    assert sorted(listed(got.select("registro_id", "cpf", "ordem", "total"))) == sorted(listed(asked))
    assert got.columns == ["registro_id", "cpf", "ordinal", "ordem", "total"] and ordinals.numbered(df.limit(0), "cpf").isEmpty()
