"""Connected components of an edge table by alternating large-star and small-star rounds.

First every vertex is hooked to the least of its lesser neighbours. Rounds over these few
edges, at most one a vertex, give partial components; of all other edges only those
between different ones are left for the rounds that finish. So densely linked groups cost
one pass over their edges.

Each round is two aggregations and joins over edges; the driver sees two numbers
per round. A vertex with very many neighbours is a skewed join key against a
unique side, which Spark splits.

Defined results: an empty table, or one of loops only, has no rows; repeated edges and
both directions of one count once; NULL ends are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least vertex it sees."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least).toDF("u", "v").where("u <> v").distinct()


def rounds(edges: DataFrame) -> DataFrame:
    now = written(edges.distinct(), "components")
    state = _state(now)
    while state[0]:
        now = written(small_star(large_star(now)), "components")
        before, state = state, _state(now)
        if state == before:
            break
    return now


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex of `edges` that isn't the least of its component, with that least vertex."""
    all_ = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    star = rounds(all_.groupBy("u").agg(F.min("v").alias("v")))
    roots = lambda end: star.select(F.col("u").alias(end), F.col("v").alias(f"r{end}"))
    left = written(all_.join(roots("u"), "u", "left").select(F.coalesce("ru", "u").alias("u"), "v"), "components")
    left = left.join(roots("v"), "v", "left").select("u", F.coalesce("rv", "v").alias("v")).where("u <> v")
    left = written(left.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    return star if left.isEmpty() else rounds(star.union(left))
