"""Cell edits of the research sheet, and saving over the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.schema import EDITABLE
from procera.sources.versions import Version, VersionedTable


class EditError(ValueError):
    """An edit names a column that is not editable."""


def editable(df: DataFrame) -> list[str]:
    allowed = {c.lower() for c in EDITABLE}
    return [c for c in df.columns if c.lower() in allowed]


def merge_edits(df: DataFrame, edits: DataFrame, key: str = "_row", check: bool = True, order: str = "_seq") -> DataFrame:
    """Apply `(key, col, val)` edits. An edit to NULL empties the cell; of repeated edits of a cell the last by the column `order` wins.

    Edits without such a column have no last one: a cell that is edited twice is refused, or with `check` off takes the greatest text.

    Values arrive as text and are cast to the column's own type; text that does not fit becomes NULL.
    """
    targets = editable(df)
    by_name = {c.lower(): c for c in targets}
    if check:
        asked = {r[0] for r in edits.select(F.lower("col")).distinct().limit(len(df.columns) + 1).collect()}
        refused = sorted(str(c) for c in asked - set(by_name))
        if refused:
            raise EditError(f"not editable: {', '.join(refused)}")
    ordered = order in edits.columns
    if check and not ordered and not edits.groupBy(key, F.lower("col")).count().where("count > 1").isEmpty():
        raise EditError(f"a cell is edited twice and the edits have no column {order}")
    own = lambda low: F.when(F.lower("col") == low, F.struct(*([F.col(order)] if ordered else []), F.col("val").alias("val")))
    cells = [F.max(own(low)).alias(f"_e_{low}") for low in by_name]
    if not cells:
        return df
    wide = edits.groupBy(key).agg(*cells)
    kinds = dict(df.dtypes)
    joined = df.join(wide, key, "left")
    changed = {c: F.when(F.col(f"_e_{low}").isNotNull(), F.col(f"_e_{low}.val").try_cast(kinds[c])).otherwise(F.col(c)) for low, c in by_name.items()}
    return joined.withColumns(changed).select(df.columns)


def save_over(df: DataFrame, path: str, base: Version | int | None = None) -> Version:
    """Replace the table at `path`, which `df` may itself read, by its next version.

    Readers through the loaders find the old rows until the new ones are whole, and never none. With `base`, the version
    that `df` comes from, a save by somebody else in between is refused (`SaveConflict`). Row places that a loader added are not stored.
    """
    return VersionedTable(df.sparkSession, path).save(df, base)
