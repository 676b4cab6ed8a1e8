"""Records in folders by month, so that a period reads its months' files only.

The month of `data_inicio` becomes the folder; undated rows have one of their own. `Filters`
turns a period into a condition on the month as well, which prunes folders before any file is opened.

Defined results: a table without `data_inicio` is refused; an empty one is kept empty. Saving makes a version (see `versions`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.functions.scalars import month
from procera.schema import MONTH, SchemaError, has
from procera.sources.versions import Version, VersionedTable


def save_by_month(df: DataFrame, path: str, base: Version | int | None = None) -> Version:
    """The next version of the table at `path`, in folders by month. Rows of a month spread over as many files as they fill."""
    if not has(df, "data_inicio"):
        raise SchemaError("no column data_inicio to take the month of")
    named = df.withColumn(MONTH, month(F.col("data_inicio")))
    # rebalanced by month: small months become one file each, a large one is split
    return VersionedTable(df.sparkSession, path).save(named.hint("rebalance", MONTH), base, partition_by=(MONTH,))
