"""Benchmark decontamination by MinHash containment search.

Items are few and short, documents many and long, so the similarity that
counts is containment: the share of an item's shingles that a document holds.
Items are partitioned by their number of shingles k. In partition k an item is
represented by its k - ceil(t k) + 1 smallest shingle hashes (its bottom-k MinHash
sketch, sized by the partition). A document with containment t misses at most
k - ceil(t k) shingles, so it holds at least one sketch hash: the search loses
no pair. Documents are probed hash by hash, and candidates are then verified by
exact containment of the shingles themselves, not of their hashes.

Defined results: words are lower-cased in A-Z only; a text of one to four words
is one shingle (the whole sequence); NULL or blank texts and items have none and
match nothing. Each (document row, item row) pair is judged by itself; repeated
rows give repeated pairs. Pairs carry doc_id and item_id as they are, NULL included.
Texts of any length are taken whole: a document's shingles are one array of its row, an item's too. A
containment of exactly the limit counts. An empty table of either kind gives no pairs. Other columns
are not looked at, whatever their names, and stay where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procera.llm.common import let, packed, small, words, written

SHINGLE = 5
PERCENT = 80


def tokens(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return words(F.translate(text, upper, lower))


def shingles(text: Column, n: int, of) -> Column:
    """`of(words)` for each run of n words, repeats included; for the whole of a shorter text."""

    def cut(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: of(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(of(w))).otherwise(F.array().cast("array<bigint>") if of is hashed else F.array().cast("array<string>"))

    return let(tokens(text), cut)


def hashed(run: Column) -> Column:
    return F.xxhash64(run)


def joined(run: Column) -> Column:
    return F.array_join(run, " ")


def need(k: Column, percent: int) -> Column:
    return F.floor((k * percent + 99) / 100).cast("int")


def row_key(id_: str) -> Column:
    """Tells rows apart by id and text; rows equal in both share it and are judged alike."""
    return F.struct(F.xxhash64(id_).alias("k1"), F.xxhash64("text").alias("k2"))


def sketches(items: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per item and sketch hash, from (item, text)."""
    hashes = F.array_sort(F.array_distinct(shingles(F.col("text"), n, hashed)))
    item = items.select("item", hashes.alias("h")).where(F.size("h") > 0)
    k = F.size("h")
    return item.select("item", need(k, percent).alias("need"), F.explode(F.slice("h", F.lit(1), k - need(k, percent) + 1)).alias("hash")).distinct()


def candidates(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Distinct (key, item) of (key, text) and (item, text) that share a sketch hash and where the document is large enough for the item."""
    probes = small(written(sketches(items, n, percent), "decontamination-sketches"))
    hashes = docs.select("key", shingles(F.col("text"), n, hashed).alias("h"))
    probed = hashes.select("key", F.size("h").alias("size"), F.explode("h").alias("hash"))
    return probed.join(probes, "hash").where(F.col("size") >= F.col("need")).select("key", "item").distinct()


def contained(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs with containment of at least `percent`: doc_id, item_id, n_shared, n_item, containment.

    Candidates are rows, told apart by id and text, so rows that share an id (NULL included) are verified for their own items only. A document's
    shingles are built once, whatever the number of its items.
    """
    rows = docs.select(row_key("doc_id").alias("key"), "doc_id", "text")
    asked = items.select(row_key("item_id").alias("item"), "item_id", "text")
    pairs = written(candidates(rows, asked, n, percent), "decontamination-candidates")
    sets = asked.select("item", "item_id", F.array_distinct(shingles(F.col("text"), n, joined)).alias("item_set"))
    sets = small(written(sets, "decontamination-items"), 10_000)
    found = written(pairs.join(sets, "item").groupBy("key").agg(F.collect_list(F.struct("item_id", "item_set")).alias("items")), "decontamination-found")
    texts = rows.join(small(found.select("key")), "key", "left_semi").join(small(found), "key")  # texts without candidates move nowhere
    shared = lambda item, own: F.struct(item["item_id"].alias("item_id"), F.size(F.array_intersect(item["item_set"], own)).alias("n_shared"), F.size(item["item_set"]).alias("n_item"))
    judged = let(shingles(F.col("text"), n, joined), lambda own: F.transform("items", lambda item: shared(item, own)))
    exact = texts.select("doc_id", F.explode(F.filter(judged, lambda x: x["n_shared"] * 100 >= x["n_item"] * percent)).alias("x")).select("doc_id", "x.*")
    ratio = F.col("n_shared").cast("double") / F.col("n_item")
    return exact.select("doc_id", "item_id", F.col("n_shared").cast("bigint").alias("n_shared"), F.col("n_item").cast("bigint").alias("n_item"), ratio.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` without the documents that contain an item. Rows are told apart by doc_id and text: only those with the item fall."""
    key = F.struct(F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2")).alias("_key")
    named = docs.select(key.alias("doc_id"), "text")
    bad = small(written(contained(named, items, n, percent).select(F.col("doc_id").alias("_bad")).distinct(), "decontamination-bad"))
    return packed(docs, key).join(bad, F.col("_key") == F.col("_bad"), "left_anti").select("row.*")


def _shingle_rows(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(list_slice(w, i, least(i + {SHINGLE - 1}, len(w))), ' ') AS s
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) AS i FROM
    (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}))"""


ORACLE = f"""
WITH i AS ({_shingle_rows("benchmark", "item_id")}),
d AS ({_shingle_rows("documents", "doc_id")}),
k AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment FROM m JOIN k USING (item_id) WHERE n_shared * 100 >= n_item * {PERCENT}"""
