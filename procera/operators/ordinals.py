"""Numbers within a key, for keys of any size.

A window over a key puts all its rows into one task. Here rows are range-sorted by key and
order, so that a large key spreads over many partitions; each partition numbers its own
part of a key, and a prefix sum over the parts' sizes (a row a key and partition) says
where that part begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procera.schema import ORDER, ordered
from procera.sources.shared import written

_PART, _INSIDE, _BEFORE = "_ordinal_part", "_ordinal_inside", "_ordinal_before"


def numbered(df: DataFrame, key: str, order: str = ORDER, ordinal: str = "ordem", total: str = "total") -> DataFrame:
    """Rows whose key is not NULL, with their number within the key (from 1, by `order`) and the key's number of rows.

    Rows equal in key and order are numbered in any order. An empty table stays empty.
    """
    kept = df.where(F.col(key).isNotNull()).repartitionByRange(key, ordered(df, order))
    dealt = written(kept.withColumn(_PART, F.spark_partition_id()), "ordinals")  # written: other samples would give other ranges
    sizes = dealt.groupBy(key, _PART).agg(F.count("*").alias("_n"))
    of_key = W.partitionBy(key)
    earlier = F.sum("_n").over(of_key.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(key, _PART, F.coalesce(earlier, F.lit(0)).alias(_BEFORE), F.sum("_n").over(of_key).alias(total))
    inside = dealt.withColumn(_INSIDE, F.row_number().over(W.partitionBy(key, _PART).orderBy(order)))
    joined = inside.join(starts, [key, _PART])
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(_BEFORE) + F.col(_INSIDE)).alias(ordinal), total)


def placed(df: DataFrame, position: str = "posicao") -> DataFrame:
    """Rows of a sorted frame with their position in it (from 1), as a grid shows them; partitions count for themselves."""
    dealt = written(df.withColumn(_PART, F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftrightunsigned(_PART, 33), F.col(_PART).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_of")).agg(F.count("*").alias("_n"))  # a row a partition
    starts = sizes.select("_of", F.coalesce(F.sum("_n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(_BEFORE))
    joined = dealt.join(F.broadcast(starts), part == F.col("_of"))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(_BEFORE) + inside + 1).alias(position))
