"""Quality rules with thresholds adapted to each language and source.

Every document gets integer metrics. Per (lang, source) each metric is
summarised in a mergeable quantile sketch: a histogram over buckets that keep the
leading bits of the value, so that any quantile is exact to 1/64 of its size and
sketches of two groups merge by adding counts. A document is rejected when a
metric lies outside the fences median +- FACTOR * max(spread, floor) of its
group, the spread being measured towards the quartile on the clean side, so
that junk making up less than half of a group cannot move its own fence. Groups
of under MIN_GROUP documents use the merged sketch of their language, then of
the whole corpus. Thresholds reach the documents by a join.

Defined results: NULL text has no words, fails the base rules and is rejected.
NULL lang or source form groups like any other value. Documents that fail the
base rules do not enter the sketches. Repeated rows count each for themselves.
A value on a fence, and equal values whatever their number, stay. Texts of any length are measured whole.
An empty table stays empty, and a group all of whose documents fail the base rules has no fence of its own. Extra columns
stay where documents are returned, whatever their names, and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procera.llm.common import let, packed, small, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 30
FACTOR = 8
#: Bits of a value that its bucket keeps.
BITS = 7
#: Metric, sides that reject, least spread. All are integers per 1,000 words, lines or hundredths of a character.
METRICS = (("word_length", "both", 25), ("symbols", "high", 10), ("dup_lines", "high", 60), ("repeats", "high", 40))


def trigram_repeats(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Sorts only where a window does repeat."""

    def count(h: Column) -> Column:
        place = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            at = lambda i: F.get(s, i)["h"]
            twice = F.filter(F.transform(s, lambda x, i: F.when((at(i - 1) == x["h"]) | (at(i + 1) == x["h"]), x["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(place, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, 3)))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, count))


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with a struct column `_q` of word counts and metrics."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        chars = F.length(F.translate(text, " \t\n\v\f\r", "")).cast("bigint")
        symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        line_counts = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
        return F.struct(n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), line_counts.alias("lines"), trigram_repeats(w).cast("bigint").alias("n_repeat_words"))

    out = docs.withColumn("_q", let(words(F.col("text")), counts))
    q = lambda name: F.col(f"_q.{name}")
    per = lambda a, b, k: F.floor(a * k / F.greatest(b, F.lit(1))).cast("bigint")
    failed = (q("n_words") < MIN_WORDS) | (q("n_repeat_words") * 100 > q("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn(
        "_q",
        F.struct(
            *(q(c).alias(c) for c in ("n_words", "word_chars", "n_symbols")),
            q("lines.dup").alias("n_dup_lines"),
            q("n_repeat_words").alias("n_repeat_words"),
            failed.alias("base_failed"),
            per(q("word_chars"), q("n_words"), 100).alias("word_length"),
            per(q("n_symbols"), q("n_words"), 1000).alias("symbols"),
            per(q("lines.dup"), q("lines.n"), 1000).alias("dup_lines"),
            per(q("n_repeat_words"), q("n_words"), 1000).alias("repeats"),
        ),
    )


def bucket(x: Column) -> Column:
    """The value with all but its leading BITS bits cleared."""
    drop = F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket) -> count, of documents that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(f"_q.{m}")).alias("bucket")) for m, *_ in METRICS))
    good = measures.where(~F.col("_q.base_failed"))
    return good.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric) -> documents, low, high, from sketches merged over the other keys."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys, "metric")
    upto = F.sum("n").over(whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    ranked = merged.select(*keys, "metric", "bucket", "n", upto.alias("upto"), F.sum("n").over(whole).alias("total"))
    quantile = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    cut = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), quantile(25).alias("q1"), quantile(50).alias("q2"), quantile(75).alias("q3"))
    least = F.create_map(*(F.lit(x) for m, _, floor in METRICS for x in (m, floor)))[F.col("metric")]
    two = F.create_map(*(F.lit(x) for m, sides, _ in METRICS for x in (m, sides == "both")))[F.col("metric")]
    high = F.col("q2") + FACTOR * F.greatest(F.col("q2") - F.col("q1"), least)
    low = F.when(two, F.col("q2") - FACTOR * F.greatest(F.col("q3") - F.col("q2"), least))
    return cut.select(*keys, "metric", "total", low.alias("low"), high.alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): a map from metric to its fences, after fallback for small groups."""
    fine, lang, all_ = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    alias = lambda df, p, *keys: df.select(*(F.col(k).alias(f"{p}_{k}") for k in keys), F.col("metric").alias(f"{p}_metric"), F.struct("low", "high").alias(f"{p}_f"), F.col("total").alias(f"{p}_total"))
    joined = (
        fine.select("lang", "source", "metric", "total", F.struct("low", "high").alias("f"))
        .join(alias(lang, "l", "lang"), F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
        .join(F.broadcast(alias(all_, "a")), F.col("metric") == F.col("a_metric"))  # one row per metric
    )
    chosen = F.when(F.col("total") >= MIN_GROUP, F.col("f")).when(F.col("l_total") >= MIN_GROUP, F.col("l_f")).otherwise(F.col("a_f"))
    return joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", chosen))).alias("_fence"))


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """Join thresholds on and add `_kept`; a group without thresholds has only base failures."""
    right = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_fence")
    on = measures["lang"].eqNullSafe(F.col("_lang")) & measures["source"].eqNullSafe(F.col("_source"))
    inside = F.lit(True)
    for metric, sides, _ in METRICS:
        fence, value = F.col("_fence")[metric], F.col(f"_q.{metric}")
        inside &= value <= fence["high"]
        if sides == "both":
            inside &= value >= fence["low"]
    kept = ~F.col("_q.base_failed") & F.coalesce(inside, F.lit(False))
    return measures.join(small(right), on, "left").withColumn("_kept", kept).drop("_lang", "_source", "_fence")


def assess(docs: DataFrame) -> DataFrame:
    """Counts and verdict per row, without text: doc_id, lang, source, n_words, ..., base_failed, kept."""
    core = written(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-metrics")
    limits = written(thresholds(sketches(core)), "quality-thresholds")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(core, limits).select("doc_id", "lang", "source", *(F.col(f"_q.{c}").alias(c) for c in names), F.col("_kept").alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """`docs` without the rejected rows, all columns as they were.

    Rows are written with their metrics: a filter on them over the plan that computes them would compute them again.
    """
    core = written(measured(packed(docs, "lang", "source", "text")).drop("text"), "quality-rows")
    limits = written(thresholds(sketches(core)), "quality-thresholds")
    return judged(core, limits).where("_kept").select("row.*")


_FENCE = """{keys} metric, max(total) AS total, min(bucket) FILTER (WHERE upto * 100 >= total * 25) AS q1, min(bucket) FILTER (WHERE upto * 100 >= total * 50) AS q2,
 min(bucket) FILTER (WHERE upto * 100 >= total * 75) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} metric) AS total
 FROM (SELECT {keys} metric, bucket, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY ALL"""
_LIMITS = f"""q2 + {FACTOR} * greatest(q2 - q1, floor_) AS high, CASE WHEN metric = 'word_length' THEN q2 - {FACTOR} * greatest(q3 - q2, floor_) END AS low"""
_FLOORS = "CASE metric " + " ".join(f"WHEN '{m}' THEN {floor}" for m, _, floor in METRICS) + " END AS floor_"


def _level(keys: str) -> str:
    return f"(SELECT *, {_LIMITS} FROM (SELECT *, {_FLOORS} FROM (SELECT {_FENCE.format(keys=keys)})))"


ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM t) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, range(3) x(o) GROUP BY doc_id),
q AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN v USING (doc_id)),
m AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed, word_chars * 100 // greatest(n_words, 1) AS word_length,
  n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM q),
u AS (UNPIVOT (SELECT doc_id, lang, source, base_failed, word_length::BIGINT AS word_length, symbols::BIGINT AS symbols, dup_lines::BIGINT AS dup_lines, repeats::BIGINT AS repeats FROM m)
  ON word_length, symbols, dup_lines, repeats INTO NAME metric VALUE x),
k AS (SELECT lang, source, metric, (x >> greatest(length(bin(x)) - {BITS}, 0)) << greatest(length(bin(x)) - {BITS}, 0) AS bucket, count(*) AS n FROM u WHERE NOT base_failed GROUP BY ALL),
f AS {_level("lang, source,")}, l AS {_level("lang,")}, a AS {_level("")},
c AS (SELECT f.lang, f.source, f.metric, CASE WHEN f.total >= {MIN_GROUP} THEN f.high WHEN l.total >= {MIN_GROUP} THEN l.high ELSE a.high END AS high,
  CASE WHEN f.total >= {MIN_GROUP} THEN f.low WHEN l.total >= {MIN_GROUP} THEN l.low ELSE a.low END AS low
  FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang AND f.metric = l.metric JOIN a ON f.metric = a.metric),
b AS (SELECT u.doc_id, bool_and(x <= high AND (low IS NULL OR x >= low)) AS inside FROM u JOIN c ON u.lang IS NOT DISTINCT FROM c.lang AND u.source IS NOT DISTINCT FROM c.source AND u.metric = c.metric GROUP BY u.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(inside, false)) AS kept FROM m LEFT JOIN b USING (doc_id)"""
