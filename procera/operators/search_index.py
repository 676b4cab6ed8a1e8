"""Stored search index: postings from three-character pieces to the values that hold them.

For every distinct value of the searched columns, upper-cased as the search sees it, the index has
one row for each piece, in folders by the piece's bucket and sorted by piece, so that a search reads
the few row groups of the pattern's pieces. Values that have all pieces of one alternative are verified
against the pattern itself; the records are then filtered by the columns' own values, which reaches
the scan. Patterns without a mandatory piece, and those that match over MOST_VALUES values,
scan the records as the plain search does.

Defined results: those of `filters.search`, for frames whose values are the indexed ones (such as any filtered part of the indexed
frame). NULL is a value of its own: it reads ``None`` to a regular expression and matches no literal. An index of other rows, told by
`source`, is not used. An empty table has an empty index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procera.functions.trigrams import required
from procera.operators import filters
from procera.schema import has
from procera.sources.versions import VersionedTable

#: Folders of the postings, and values that become part of a filter.
BUCKETS, MOST_VALUES = 64, 10_000


def bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def read_as(value: Column) -> Column:
    """A value as the search sees it."""
    return F.upper(F.coalesce(value, F.lit("None")))


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def build(self, df: DataFrame, columns: tuple[str, ...] = filters.RECORD_SEARCH, source: str = "") -> SearchIndex:
        """Index the columns' values; readers keep the previous index until this one is whole. `source` names the rows' state."""
        present = [c for c in columns if has(df, c)]
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present))).alias("v")
        values = df.select(each).select("v.*").distinct()
        text = read_as(F.col("value"))
        starts = F.when(F.length(text) > 2, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
        split = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))
        rows = values.select("column", "value", F.explode(split).alias("piece")).select("*", bucket(F.col("piece")).alias("bucket"), F.lit(source).alias("source"))
        self.table.save(rows.repartition("bucket").sortWithinPartitions("bucket", "piece", "column"), partition_by=("bucket",))
        return self

    def source(self) -> str | None:
        """State of the rows that are indexed; None for an empty index."""
        row = self.table.read().select("source").first()
        return row and row[0]

    def values(self, pattern: str, columns: list[str], literal: bool) -> DataFrame | None:
        """(column, value) that match the upper-cased pattern; None where it has no mandatory piece."""
        options = required(pattern, literal)
        if options is None:
            return None
        asked = sorted({p for o in options for p in o})
        postings = self.table.read()
        spark = postings.sparkSession
        folders = [r[0] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("p")).select(bucket(F.col("p"))).distinct().collect()]
        found = postings.where(F.col("bucket").isin(folders) & F.col("piece").isin(asked) & F.col("column").isin(columns))
        held = found.groupBy("column", "value").agg(F.collect_set("piece").alias("held"))
        whole = lambda o: F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(o))))) == len(o)
        likely = held.where(reduce(lambda a, b: a | b, map(whole, options)))
        text = read_as(F.col("value"))
        exact = F.col("value").isNotNull() & text.contains(pattern) if literal else text.rlike(pattern)
        return likely.where(exact).select("column", "value")

    def search(self, df: DataFrame, term: str, columns: tuple[str, ...] = filters.RECORD_SEARCH, literal: bool = False, source: str | None = None) -> DataFrame:
        """The rows that `filters.search` gives, by way of the index where it helps."""
        present = [c for c in columns if has(df, c)]
        scan = filters.search(df, term, columns, literal)  # also refuses what is no pattern
        if not term or not present or source is not None and self.source() != source:
            return scan
        matching = self.values(term.upper(), present, literal)
        hits = None if matching is None else matching.limit(MOST_VALUES + 1).collect()
        if hits is None or len(hits) > MOST_VALUES:
            return scan
        parts = []
        for c in present:
            own = [h.value for h in hits if h.column == c]
            if None in own:
                parts.append(F.col(c).isNull())
            if texts := [v for v in own if v is not None]:
                parts.append(F.col(c).cast("string").isin(texts))
        return df.where(reduce(lambda a, b: a | b, parts, F.lit(False)))

    def patient_search(self, df: DataFrame, term: str, literal: bool = False, source: str | None = None) -> DataFrame:
        return self.search(df, term, filters.PATIENT_SEARCH, literal, source)
