"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue whose documents stand in a seeded shuffle, up to three
times over. A document's virtual finish time is the source's cumulative words,
itself included, divided by the source's target. Sorting all queues by finish
time interleaves them in proportion to their targets; the mix is the prefix of
that order that fits the budget.

The order is never made by one task. Cumulative words are prefix sums over
hash buckets of each source (so that a source with a third of the rows spreads
over all tasks), and the cut is found by histograms of finish times, each over the
interval that the budget ends in by the one before, until that interval holds at
most EDGE turns, which are sorted. Finish times of one queue differ, so intervals shrink to
at most a turn a source.

Defined results: NULL text has size 0 and is never taken; NULL source is a
source of its own, last in order; repeated rows count each for themselves; an
empty table gives no rows. Extra columns are ignored by `mix`, and kept by `drawn`,
where rows equal in doc_id and text become one. Ties go by source, then place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procera.llm.common import packed, words, written

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 17
BUCKETS = 4096
#: Intervals of a histogram, units of virtual time that the first one spans, and turns that one task sorts.
TICKS, UNITS, EDGE = 1024, 4, 20_000


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Words and shuffle place of every row, without its text."""
    text = F.coalesce("text", F.lit(""))
    tag = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(text)))
    number = lambda a, n: F.conv(F.substring(tag, a, n), 16, 10).cast("bigint")
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("queue"),
        "source",
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        (number(1, 4) % BUCKETS).cast("int").alias("bucket"),
        number(5, 14).alias("place"),
        F.xxhash64("doc_id").alias("k1"),
        F.xxhash64("text").alias("k2"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per queue: weight in code-point order of sources, capped target.

    Capping and resharing until nothing exceeds its cap has a closed form: in
    order of cap / weight, queues are full while their cap is at most their
    share of what is left; the first other one fixes the level of all the rest.
    """
    per = sizes.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int")).cast("bigint")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / heavy.cast("double"))
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("weight"), F.col("level").alias("level")))
    level = F.min(open_).over(W.partitionBy())["level"]
    share = level * F.col("weight")
    full = level.isNull() | (F.col("cap") <= share)
    return per.select("queue", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def finish(epoch: int) -> Column:
    return (F.col("served") + F.col("source_size") * epoch).cast("double") / F.col("target")


def tick(epoch: int, low: float, width: float) -> Column:
    """Interval of a finish time at or after `low`, in TICKS intervals that span `width`; later ones fall into the last."""
    return F.greatest(F.lit(0), F.least(F.floor((finish(epoch) - low) / (width / TICKS)), F.lit(TICKS - 1))).cast("int")


def _mixed(docs: DataFrame, weights: tuple[int, ...], repeats: int, seed: int) -> DataFrame:
    sizes = written(sized(docs, seed), "mix-sizes")
    per_bucket = sizes.groupBy("queue", "source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(per_bucket, weights, repeats)
    earlier = W.partitionBy("queue").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    start = per_bucket.select("queue", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    here = W.partitionBy("queue", "bucket").orderBy("place", "doc_id", "size")
    placed = (
        sizes.join(start.join(goal, "queue"), ["queue", "bucket"])
        .withColumn("served", F.col("start") + F.sum("size").over(here.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("turn", F.row_number().over(here))
    )
    placed = written(placed.select("doc_id", "source", "queue", "bucket", "turn", "size", "source_size", "target", "served", "k1", "k2"), "mix-queues")
    some = placed.where("size > 0")
    budget = some.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()[0]

    # Turns before the interval at hand are taken, those behind it are not; `inside` tells those in it.
    taken, inside = [F.lit(False)] * repeats, [F.lit(True)] * repeats
    low, width, before, endless = 0.0, float(UNITS), 0, True  # endless: the last interval has no end
    while True:
        bins = [F.when(i, tick(e, low, width)) for e, i in enumerate(inside)]
        held = some.select("size", F.explode(F.array_compact(F.array(*bins))).alias("tick")).groupBy("tick").agg(F.sum("size").alias("size"), F.count("*").alias("turns"))
        upto = F.sum("size").over(W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)) + before  # TICKS rows at most
        edge = held.select("tick", "size", "turns", upto.alias("upto")).where(F.col("upto") >= budget).orderBy("tick").limit(1).first()
        if edge is None:
            taken = [t | i for t, i in zip(taken, inside, strict=True)]
            break
        at = [F.coalesce(b, F.lit(-1)) for b in bins]
        taken = [t | ((b >= 0) & (b < edge["tick"])) for t, b in zip(taken, at, strict=True)]
        inside = [b == edge["tick"] for b in at]
        before = edge["upto"] - edge["size"]
        finer = width / TICKS
        if edge["turns"] <= EDGE or low + edge["tick"] * finer + finer / TICKS == low + edge["tick"] * finer:  # few, or all at one time
            rank = lambda e: F.struct(finish(e).alias("f"), "queue", "bucket", "turn", F.lit(e).alias("e"))
            last = some.select("size", F.explode(F.array_compact(F.array(*(F.when(i, rank(e)) for e, i in enumerate(inside))))).alias("r"))
            filled = F.sum("size").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, 0)) + before
            cut = last.select("r", filled.alias("filled")).where(F.col("filled") <= budget).agg(F.max("r")).first()[0]
            if cut is not None:
                end = F.struct(*(F.lit(cut[c]).alias(c) for c in ("f", "queue", "bucket", "turn", "e")))
                taken = [t | (i & (rank(e) <= end)) for e, (t, i) in enumerate(zip(taken, inside, strict=True))]
            break
        endless &= edge["tick"] == TICKS - 1
        low, width = low + edge["tick"] * finer, width * TICKS if endless else finer
    times = sum((F.when(t, 1).otherwise(0) for t in taken), F.lit(0))
    words_taken = F.when(F.col("size") > 0, F.col("size") * times).otherwise(0).cast("bigint")
    return placed.select("doc_id", "size", "source_size", "target", words_taken.alias("taken"), "source", "k1", "k2")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken (words, repeats counted), source."""
    return _mixed(docs, weights, repeats, seed).drop("k1", "k2")


def drawn(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: all columns of `docs` in a struct `row`, size, source_size, target, taken and copies (times it stands in the mix)."""
    turns = _mixed(docs, weights, repeats, seed).where("taken > 0")
    per = turns.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")
    )
    per = written(per, "mix-taken")
    rows = packed(docs, F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"))
    kept = rows.join(per, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    if not per.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["k1", "k2"])
    return kept.select("row", "size", "source_size", "target", "taken", (F.col("taken") / F.col("size")).cast("int").alias("copies"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  coalesce('s' || source, 'n') AS queue, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS tag FROM documents),
b AS (SELECT *, ('0x' || substr(tag, 1, 4))::BIGINT % {BUCKETS} AS bucket, ('0x' || substr(tag, 5, 14))::BIGINT AS place FROM d),
s AS (SELECT queue, source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM b GROUP BY queue, source),
l AS (SELECT *, 3 * source_size AS cap,
  (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level FROM s
  WINDOW w AS (ORDER BY 3 * source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, {{'a': cap / weight, 'b': weight, 'c': level}}) AS level FROM l WHERE cap > level * weight),
t AS (SELECT queue, source_size, CASE WHEN f.level IS NULL OR cap <= f.level * weight THEN cap::DOUBLE ELSE f.level * weight END AS target FROM l LEFT JOIN f ON true),
q AS (SELECT doc_id, queue, bucket, size, source_size, target,
  sum(size) OVER (PARTITION BY queue ORDER BY bucket, place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served,
  row_number() OVER (PARTITION BY queue ORDER BY bucket, place, doc_id, size) AS turn FROM b JOIN t USING (queue)),
i AS (SELECT *, (served + e * source_size)::DOUBLE / target AS finish FROM q, range(3) r(e) WHERE size > 0),
c AS (SELECT queue, turn, size, sum(size) OVER (ORDER BY finish, queue, turn, e ROWS UNBOUNDED PRECEDING) AS upto FROM i),
k AS (SELECT queue, turn, sum(size)::BIGINT AS taken FROM c WHERE upto <= (SELECT sum(size) FROM b) GROUP BY queue, turn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (queue, turn)"""
