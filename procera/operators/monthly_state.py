"""Indicators kept by month: exact distinct counts that merge.

A dictionary gives every patient and surgeon a number, once and for ever. A month keeps its rows, the sum and number of
durations, and per kind a bitmap of the numbers that occur (4 KB for 32,768 numbers). Bitmaps of
any months merge by OR, so the indicators of any choice of months come from their states, and adding a month
reads that month's records only.

Defined results: those of `overview.kpi` for the rows of the chosen months; undated rows are a month of their own (`NaT`). Adding
rows of a month that is there replaces that month. NULL is no patient and no surgeon; absent columns count
nothing. An empty frame changes nothing; a state without months has zeros.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procera.functions.scalars import month_or_marker
from procera.schema import has
from procera.sources.shared import written

KINDS = ("cpf", "cirurgiao")
_DICTIONARY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("id", T.LongType())])
#: One row a month (kind NULL) with its sums, and one a month, kind and bucket with a bitmap.
_STATE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("minutes", T.DoubleType()),
        T.StructField("timed", T.LongType()),
        T.StructField("mes", T.StringType()),
    ]
)


class MonthlyState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def states(self) -> DataFrame:
        return self._read("months", _STATE)

    def _numbers(self, used: DataFrame) -> DataFrame:
        """The dictionary, after numbering those of (kind, value) that are new. Numbers go on from the last, partition after partition."""
        known = self._read("dictionary", _DICTIONARY)
        last = known.agg(F.max("id")).first()[0] or 0
        new = written(used.select("kind", "value").distinct().join(known, ["kind", "value"], "left_anti").withColumn("part", F.spark_partition_id()), "new-values")
        sizes = new.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
        starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        place = F.row_number().over(W.partitionBy("part").orderBy("kind", "value"))
        numbered = new.join(F.broadcast(starts), "part").select("kind", "value", (F.lit(last) + F.col("before") + place).alias("id"))
        numbered.write.mode("append").parquet(f"{self.path}/dictionary")
        return self._read("dictionary", _DICTIONARY)

    def add(self, df: DataFrame) -> None:
        """Take in the rows of one or more whole months; their states replace earlier ones."""
        mes = month_or_marker(F.col("data_inicio")) if has(df, "data_inicio") else month_or_marker(F.lit(None).cast("timestamp_ntz"))
        minutes = F.col("duracao_minutos").cast("double") if has(df, "duracao_minutos") else F.lit(None).cast("double")
        sums = df.groupBy(mes.alias("mes")).agg(F.count("*").alias("n"), F.sum(minutes).alias("minutes"), F.count(minutes).alias("timed"))
        none = {f.name: F.lit(None).cast(f.dataType) for f in _STATE}
        rows = lambda found, **own: found.select(*((own.get(c) if c in own else F.col(c) if c in found.columns else none[c]).alias(c) for c in _STATE.names))
        state = rows(sums)
        pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in KINDS if has(df, c)]
        if pairs:
            used = written(df.select(mes.alias("mes"), F.explode(F.array(*pairs)).alias("p")).select("mes", "p.*").where("value IS NOT NULL").distinct(), "month-values")
            ids = used.join(self._numbers(used), ["kind", "value"])
            bits = ids.groupBy("mes", "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
            state = state.union(rows(bits))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mes").parquet(f"{self.path}/months")

    def kpi(self, months: Iterable[str] | None = None) -> DataFrame:
        """`overview.kpi` of all months, or of those named (``yyyy-MM``)."""
        states = self.states()
        if months is not None:
            states = states.where(F.col("mes").isin(list(months)))
        merged = states.where("kind IS NOT NULL").groupBy("kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("distinct"))
        of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("distinct"))), F.lit(0)).cast("bigint")
        counts = merged.agg(of("cpf").alias("pacientes"), of("cirurgiao").alias("cirurgioes"))
        mean = F.coalesce((F.sum("minutes") / F.nullif(F.sum("timed"), F.lit(0))), F.lit(0.0)).cast("int")
        sums = states.where("kind IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), mean.alias("duracao_media"))
        return sums.join(counts).select("total", "pacientes", "cirurgioes", "duracao_media")  # one row each
