"""Secret scan with a trigram inverted index.

Each rule's regex yields a Boolean trigram query. The index holds, for every
trigram that some rule asks for, the documents whose lower-cased text contains
it. Posting lists are intersected per conjunction (as bit sets of matched
trigrams), giving each rule its candidate documents; only those are verified with
the regex. Rules without a mandatory trigram scan every text.

Spans are half-open code-point ranges of leftmost, non-overlapping matches;
matches whose measured group is too short are dropped after matching.

Defined results: NULL text is empty and has no spans; repeated rows are scanned
each for themselves; rows sharing a doc_id (NULL included) share candidates,
which are a superset, and are verified apart. Ties in start go by the rules' order. Texts of any
length and number of matches are scanned whole, in time in proportion. An empty table gives no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procera.llm.common import let, same, small, written
from procera.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Trigram queries as literal rows, so that no Python worker is started for them.
QUERIES = "array<struct<rule:int,part:int,trigram:string,bit:bigint,full:bigint>>"
#: Matches whose spans are gathered at once.
BLOCK = 256
#: Kinds that the base digest covers.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def searched(rule: Rule) -> str:
    """The regex to run. For one greedy character class the least length moves into the pattern: maximal runs stay the same."""
    if rule.kind == "hex":
        return rf"[0-9a-f]{{{rule.least},}}"
    return rule.regex


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)).cast("array<string>"))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, mask): bit i is set if rule i's trigram query holds for the document."""
    spark = docs.sparkSession
    rows = []
    for i, rule in enumerate(rules):
        for j, conjunction in enumerate(sorted(map(sorted, trigram_query(rule.regex)))):
            rows += [(i, j, t, 1 << k, (1 << len(conjunction)) - 1) for k, t in enumerate(conjunction)]
    queries = spark.range(1).select(F.inline(F.array(*(F.struct(*map(F.lit, r)) for r in rows)).cast(QUERIES)))
    hits = index(docs, sorted({r[2] for r in rows})).join(F.broadcast(queries), "trigram")  # one row per rule and trigram
    matched = hits.groupBy("doc_id", "rule", "part", "full").agg(F.bit_or("bit").alias("seen")).where("seen = full")
    return matched.groupBy("doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("rule"))).alias("mask"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's matches in `text`."""
    regex = F.lit(searched(rule))

    def placed(matches: Column) -> Column:
        gaps = F.split(text, searched(rule), -1)
        sized = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matches
        steps = F.zip_with(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), sized, lambda x, y: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("n"), F.length(y).alias("m")))

        def add(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["n"]).alias("end"))
            kept = F.when(x["m"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
            return F.struct((start + F.coalesce(x["n"], F.lit(0))).alias("at"), kept.alias("out"))

        empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        none = F.array().cast("array<array<struct<start:int,kind:int,end:int>>>")

        # Spans gather in blocks, and blocks in a list of lists: a text of very many matches is not copied at each of them.
        def add_block(state: Column, block: Column) -> Column:
            inner = F.aggregate(block, F.struct(state["at"].alias("at"), empty.alias("out")), add)
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], F.array(i["out"])).alias("out")))

        cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: F.slice(s, k * BLOCK + 1, BLOCK))
        return F.aggregate(let(steps, cut), F.struct(F.lit(0).alias("at"), none.alias("out")), add_block, lambda s: F.flatten(s["out"]))

    found = F.regexp_extract_all(text, regex, F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id and `spans`, an array of (start, kind index, end) in order of start, then kind."""
    masks = small(written(candidates(docs, rules).withColumnRenamed("doc_id", "_id"), "secret-candidates"))
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(masks, same(F.col("doc_id"), F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, rule in enumerate(rules):
        if frozenset() in trigram_query(rule.regex):
            found.append(spans(F.col("text"), rule, i))
        else:
            asked = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
            found.append(F.when(asked, spans(F.col("text"), rule, i)).otherwise(none))
    return joined.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    written_ = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    base = len(BASE)
    of_kind = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("bigint").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    text = lambda a: F.array_join(F.transform(a, written_), ",")
    digest = F.sha2(text(F.filter("spans", lambda s: s["kind"] < base)), 256)
    return scan(docs, rules).select("doc_id", *counts, digest.alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _rule_sql(i: int, rule: Rule) -> str:
    return f"""SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, string_split_regex(text, '{_q(searched(rule))}') AS gaps, regexp_extract_all(text, '{_q(searched(rule))}') AS ms,
    regexp_extract_all(text, '{_q(searched(rule))}', {rule.group}) AS gs, {rule.least} AS least FROM d WHERE regexp_matches(text, '{_q(searched(rule))}')"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))}),
e AS (SELECT doc_id, k, kind, least, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[:len(ms)]) AS gap FROM r),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i)::BIGINT AS stop FROM e),
s AS (SELECT doc_id, k, kind, stop - length(m) AS start, stop, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM p WHERE length(g) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
 sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
