"""States by month merge to what the records give, and dates that fit no pattern are told."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from procera.functions import scalars
from procera.operators import overview
from procera.operators.monthly_state import MonthlyState
from procera.sources import loading
from procera.sources.adapter import registros

SF = "/root/testdata/sf0.001"


def test_months_merge_and_are_replaced(spark, tmp_path):
    df = registros(spark, SF).cache()
    state = MonthlyState(spark, f"{tmp_path}/s")
    assert tuple(state.kpi().first()) == (0, 0, 0, 0)
    year = F.year("data_inicio")
    for part in (df.where(year == 1993), df.where(year == 1995), df.where("data_inicio IS NULL"), df.limit(0)):
        state.add(part)
    seen = df.where(year.isin(1993, 1995) | F.col("data_inicio").isNull())
    assert tuple(state.kpi().first()) == tuple(overview.kpi(seen).first())
    month = df.where(F.date_format("data_inicio", "yyyy-MM") == "1995-04")
    assert tuple(state.kpi(["1995-04"]).first()) == tuple(overview.kpi(month).first())
    assert tuple(state.kpi(["NaT"]).first()) == tuple(overview.kpi(df.where("data_inicio IS NULL")).first())
    cut = month.where("registro_id % 2 = 0")
    state.add(cut)  # the month again, with fewer rows and a patient more
    state.add(cut.unionByName(cut.limit(1).withColumn("cpf", F.lit("novo"))))
    got, want = state.kpi(["1995-04"]).first(), overview.kpi(cut).first()
    assert (got.total, got.pacientes) == (want.total + 1, want.pacientes + 1)
    ids = [r.id for r in spark.read.parquet(f"{tmp_path}/s/dictionary").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))  # dense, none given twice


def test_a_month_is_added_without_reading_others(spark, tmp_path):
    df = registros(spark, SF).cache()
    year = F.year("data_inicio")
    state = MonthlyState(spark, f"{tmp_path}/s")
    state.add(df.where(year == 1993))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s/months").glob("mes=1993*/*.parquet")}
    state.add(df.where(year == 1994))
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s/months").glob("mes=1993*/*.parquet")}
    bare = MonthlyState(spark, f"{tmp_path}/b")
    bare.add(df.select("registro_id"))
    assert tuple(bare.kpi().first()) == (df.count(), 0, 0, 0)


@pytest.mark.parametrize(
    ("text", "value"),
    [("2024-01-05T07:05", "2024-01-05 07:05"), ("2024-01-05T07:05:09", "2024-01-05 07:05:09"), ("05-01-2024", "2024-01-05"), ("5-1-2024 7:05", "2024-01-05 07:05"), ("05/01/24", "2024-01-05"), ("05/03/70", "1970-03-05"), ("31/12/68", "2068-12-31"), ("1/1/69 0:00", "1969-01-01"), ("05/01/024", None), ("2024/01/05", None)],
)
def test_more_forms_of_dates(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(scalars.parse_date(F.col("t"))).first()[0]
    assert got == (value and dt.datetime.fromisoformat(value))


def test_rejected_dates_are_counted_in_the_same_pass(spark):
    rows = [("31/12/2023", "x"), ("junk", None), ("junk", "  "), ("32/01/2024", "01/02/2024"), (None, "")]
    raw = spark.createDataFrame(rows, "data_inicio string, data_fim string")
    seen = Observation()
    parsed = loading.normalise_dates(raw, observation=seen)
    assert parsed.columns == raw.columns and [r.data_inicio is None for r in parsed.collect()] == [False, True, True, True, True]
    assert seen.get == {"rejected_data_inicio": 3, "rejected_data_fim": 1}
    assert sorted(map(tuple, loading.rejected_dates(raw).collect())) == [("data_fim", "x", 1), ("data_inicio", "32/01/2024", 1), ("data_inicio", "junk", 2)]
    assert loading.rejected_dates(raw.limit(0)).isEmpty() and loading.rejected_dates(spark.range(1)).isEmpty()
