"""Shapes the star-schema test tables like the fact table, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procera.schema import ORDER
from procera.sources.loading import with_order

_BODY = """
SELECT o_orderkey AS registro_id,
 CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderpriority END AS tipo_procedimento,
 CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE CAST(1000000 + o_custkey AS VARCHAR) END AS prontuario,
 c_name AS nome,
 CASE WHEN o_custkey % 89 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS cpf,
 n_name AS municipio, c_mktsegment AS tipo_atendimento,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS data_inicio,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(30 + o_orderkey % 211 AS INT) END AS duracao_minutos,
 CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderstatus END AS lateralidade,
 CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat(p_name, ' ', p_type) END AS cirurgiao,
 CASE WHEN o_custkey % 71 = 0 THEN NULL ELSE TIMESTAMP '1940-01-01' + to_days(CAST(o_custkey * 37 % 25000 AS INTEGER)) END AS dt_nascimento,
 CASE WHEN o_custkey % 43 = 0 THEN NULL ELSE CAST(18 + o_custkey % 70 AS INT) END AS idade,
 CASE WHEN o_custkey % 67 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexo,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate + to_hours(CAST(2 + o_orderkey % 24 AS INTEGER)) END AS data_fim,
 CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderdate END AS data_atendimento,
 CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) END AS data_alta,
 CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE concat('DR ', o_orderkey % 17) END AS anestesista,
 CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE concat('SALA ', o_orderkey % 9) END AS centro_sala
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN part ON p_partkey = o_orderkey % 200
"""
#: Opens every oracle text: only the raw tables are views there.
WITH_REGISTROS = f"WITH registros AS ({_BODY})"


def unless(divisor: int, key: str, value) -> F.Column:
    return F.when(F.col(key) % divisor != 0, value)


def registros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows at the grain of `orders`; the dimension joins are left to the optimizer."""
    return _shaped(spark, sf_dir, F.col("o_orderkey").alias("registro_id"))


def registros_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without an identifier of their own: their order is their place in the source file, as the reader tells it."""
    return _shaped(spark, sf_dir, F.col("registro_id"))


def _shaped(spark: SparkSession, sf_dir: str, place: F.Column) -> DataFrame:
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    orders = with_order(spark.read.parquet(f"{sf_dir}/orders.parquet")).select(ORDER, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = read("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read("nation", "n_nationkey", "n_name")
    part = read("part", "p_partkey", "p_name", "p_type").where("p_partkey < 200")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("p_partkey") == F.col("o_orderkey") % 200)
    )
    later = lambda days=0, hours=0: F.make_dt_interval(F.lit(days) if isinstance(days, int) else days.cast("int"), F.lit(hours) if isinstance(hours, int) else hours.cast("int"))
    order, person, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    started = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return joined.select(
        place,
        unless(53, "o_orderkey", F.col("o_orderpriority")).alias("tipo_procedimento"),
        unless(61, "o_orderkey", (F.col("o_custkey") + 1000000).cast("string")).alias("prontuario"),
        F.col("c_name").alias("nome"),
        unless(89, "o_custkey", F.col("o_custkey").cast("string")).alias("cpf"),
        F.col("n_name").alias("municipio"),
        F.col("c_mktsegment").alias("tipo_atendimento"),
        unless(97, "o_orderkey", started).alias("data_inicio"),
        unless(41, "o_orderkey", (F.col("o_orderkey") % 211 + 30).cast("int")).alias("duracao_minutos"),
        unless(31, "o_orderkey", F.col("o_orderstatus")).alias("lateralidade"),
        unless(101, "o_orderkey", F.concat_ws(" ", "p_name", "p_type")).alias("cirurgiao"),
        unless(71, "o_custkey", F.lit("1940-01-01").cast("timestamp_ntz") + later(days=person * 37 % 25000)).alias("dt_nascimento"),
        unless(43, "o_custkey", (person % 70 + 18).cast("int")).alias("idade"),
        unless(67, "o_custkey", F.when(person % 2 == 0, "F").otherwise("M")).alias("sexo"),
        unless(97, "o_orderkey", day + later(hours=order % 24 + 2)).alias("data_fim"),
        unless(47, "o_orderkey", day).alias("data_atendimento"),
        unless(59, "o_orderkey", day + later(days=order % 9)).alias("data_alta"),
        unless(83, "o_orderkey", F.concat(F.lit("DR "), (order % 17).cast("string"))).alias("anestesista"),
        unless(79, "o_orderkey", F.concat(F.lit("SALA "), (order % 9).cast("string"))).alias("centro_sala"),
    )
