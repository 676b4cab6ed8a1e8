"""Plans that read less: folders by month, all domains at once, types without a list."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from procera.operators import overview, surgeons
from procera.operators.filters import Filters
from procera.schema import MONTH, SchemaError
from procera.sources.adapter import registros
from procera.sources.by_month import save_by_month
from procera.sources.loading import load_parquet

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    return registros(spark, SF).cache()


def test_period_reads_its_months_only(spark, facts, tmp_path):
    path = f"{tmp_path}/f"
    save_by_month(facts, path)
    kept = load_parquet(spark, path)
    spoilt = 0
    for file in (tmp_path / "f/_data").rglob("*.parquet"):  # other months' files can't be read any more
        if not "1995-03" <= file.parent.name.partition("=")[2] <= "1995-05":
            file.write_bytes(b"spoilt")
            file.with_name(f".{file.name}.crc").unlink()
            spoilt += 1
    assert spoilt > 50
    for end_of_day in (False, True):
        chosen = Filters(period=(dt.date(1995, 3, 7), dt.date(1995, 5, 2)), end_of_day=end_of_day)
        found = chosen.apply(kept)
        assert sorted(r.registro_id for r in found.collect()) == sorted(r.registro_id for r in chosen.apply(facts).collect())
        assert "PartitionFilters: [isnotnull(mes_inicio" in found._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="parquet"):
        kept.where("registro_id > 0").collect()


def test_folders_by_month_hold_all_rows(spark, facts, tmp_path):
    path = f"{tmp_path}/f"
    save_by_month(facts, path)
    kept = load_parquet(spark, path)
    assert kept.count() == facts.count() and kept.where(f"{MONTH} IS NULL").count() == facts.where("data_inicio IS NULL").count()
    whole = Filters.default(kept).apply(kept)
    assert sorted(r.registro_id for r in whole.collect()) == sorted(r.registro_id for r in Filters.default(facts).apply(facts).collect())
    save_by_month(kept.where("data_inicio IS NULL"), path)  # over itself
    assert load_parquet(spark, path).count() == facts.where("data_inicio IS NULL").count()
    with pytest.raises(SchemaError):
        save_by_month(facts.select("registro_id"), path)


def test_all_domains_in_one_pass(spark, facts):
    found = overview.domains(facts)
    for c in Filters.MEMBERSHIP:
        assert [r.valor for r in found.where(F.col("coluna") == c).orderBy("valor").collect()] == [r[0] for r in overview.domain(facts, c).collect()]
    raw = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderstatus").alias("lateralidade"), F.col("o_orderpriority").alias("tipo_procedimento"))
    plan = overview.domains(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert overview.domains(facts.select("registro_id")).isEmpty() and overview.domains(facts.limit(0)).isEmpty()


def test_any_number_of_types(spark):
    n = 1500
    df = spark.range(4 * n).select(
        F.col("id").alias("registro_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("cir"), F.col("id") % 2)).alias("cirurgiao"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("tipo"), (F.col("id") * 7) % n)).otherwise(F.when(F.col("id") % 2 == 0, "")).alias("tipo_procedimento"),
        F.when(F.col("id") % 5 > 0, "p").alias("prontuario"),
    )
    with pytest.raises(ValueError):
        surgeons.ranking_pivot(df)
    rows = df.collect()
    order = list(dict.fromkeys(r.tipo_procedimento for r in rows if r.tipo_procedimento))
    assert len(order) > 1000
    for got in surgeons.ranking_map(df).collect():
        mine = [r for r in rows if r.cirurgiao == got.cirurgiao]
        assert got.Total == sum(r.prontuario is not None for r in mine)
        want = {t: 0 for t in order if any(r.tipo_procedimento == t for r in mine)}
        for r in mine:
            if r.tipo_procedimento:
                want[r.tipo_procedimento] += r.prontuario is not None
        assert got.tipos == want
        in_order = surgeons.ranking_map(df).where(F.col("cirurgiao") == got.cirurgiao).select(F.posexplode("tipos").alias("at", "tipo", "n")).orderBy("at")
        assert [r.tipo for r in in_order.collect()] == list(want)
    only = surgeons.ranking_map(df.where("tipo_procedimento IS NULL OR tipo_procedimento = ''")).collect()
    assert [r.tipos for r in only] == [{}, {}] and surgeons.ranking_map(df.limit(0)).isEmpty()
