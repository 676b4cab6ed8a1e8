"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verified Hamming distance.

A 64-bit fingerprint is cut into four 16-bit blocks. Two fingerprints at
Hamming distance at most 2 agree on at least two blocks, so every pair of
blocks is a key and close fingerprints share one of six keys. Only distinct
fingerprints are compared: copies meet by equality. A key that more than
MOST fingerprints share is not compared pairwise; its fingerprints are keyed
again by 14 of their 16 4-bit blocks (120 keys, each of at most 256 fingerprints),
which close pairs again share, so nothing is lost. Inside a key only the edges
of a spanning forest leave the task. Links become components by star rounds.

Defined results: words are runs of non-blank characters, lower-cased in A-Z;
fewer than three words are one shingle; texts without words (NULL, empty, blank)
have fingerprint 0 and link like any other. Repeated rows keep their rows.
component_id is the least non-null doc_id of the component, NULL if it has none.
Texts of any length are taken whole. An empty table gives no rows. Extra columns are ignored,
whatever their names, and kept where documents are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import packed, small, written
from procera.llm.components import components
from procera.llm.runs import mixed

SHINGLE = 3
SEED = 42
DISTANCE = 2
MOST = 128
#: Shingles whose bits are counted at a time.
SLAB = 1 << 15
#: Keys with over 1 / HOT of all rows are broadcast; there are fewer than HOT of them.
HOT = 1000


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: bit i is 1 if set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])
    count = max(1, len(words) - n + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, count)
    set_ = np.zeros(64, np.int64)
    for at in range(0, count, SLAB):
        bits = np.unpackbits(hashes[at : at + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > count, bitorder="little").view("<u8")[0])


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_prints, f"doc_id {kind}, fp bigint")


def keyed(distinct: DataFrame, width: int, left_out: int) -> DataFrame:
    """Rows (fp, choice, key): for every choice of `width`-bit blocks that leaves `left_out` out, the fingerprint with those cleared."""
    whole = (1 << 64) - 1
    masks = []
    for gone in combinations(range(0, 64, width), left_out):
        mask = whole - sum(((1 << width) - 1) << at for at in gone)
        masks.append(mask - (mask >> 63 << 64))
    rows = distinct.select("fp", F.posexplode(F.lit(masks).cast("array<bigint>")).alias("choice", "mask"))
    return rows.select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning-forest edges among the fingerprints of each (bounded) group."""
    for b in batches:
        us: list[int] = []
        vs: list[int] = []
        for group in b.column(0):
            fps = np.unique(np.array(group.as_py(), np.int64))
            near = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= DISTANCE
            seen = np.zeros(len(fps), bool)
            for start in range(len(fps)):
                if seen[start]:
                    continue
                seen[start] = True
                todo = [start]
                while todo:
                    at = todo.pop()
                    new = np.flatnonzero(near[at] & ~seen)
                    seen[new] = True
                    us += [int(fps[at])] * len(new)
                    vs += fps[new].tolist()
                    todo += new.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints at distance 2 or less, from a table of distinct `fp`."""
    keys = keyed(distinct, 16, 2)
    shared = written(keys.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    few, many = shared.where(F.col("n") <= MOST).drop("n"), shared.where(F.col("n") > MOST).drop("n")
    crowded = keys.join(many, ["choice", "key"], "left_semi").select("fp").distinct()
    group = lambda rows: rows.groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    groups = group(keys.join(few, ["choice", "key"], "left_semi")).union(group(keyed(crowded, 4, 2)))
    return groups.mapInArrow(_links, "u bigint, v bigint")


def classed(rows: DataFrame, class_: DataFrame, key: str) -> DataFrame:
    """`rows` joined with the one row that `class_` has for their key, which also counts them (copies, left out of the result).

    Keys with over 1 / HOT of all rows are broadcast, so that no task gets all rows of one; the others are shuffled.
    Rows whose key is NULL or not in `class_` give none.
    """
    class_ = written(class_, "simhash-classes")
    crowded = F.col("copies") * HOT > (class_.agg(F.sum("copies")).first()[0] or 0)
    hot = F.broadcast(class_.where(crowded).drop("copies"))
    return rows.join(hot, key).union(rows.join(hot, key, "left_anti").join(class_.where(~crowded).drop("copies"), key))


def grouped(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp (signed), component_id."""
    prints = written(fingerprints(docs), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-nodes")
    star = components(links(nodes.select("fp")))
    member = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(star.select(F.col("v"), F.col("v")).distinct())
    roots = member.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("copies"))
    linked = classed(member, roots, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    class_ = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), "copies")
    return classed(prints, class_, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return grouped(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


# Similar documents: a wide fingerprint for similarities that move many bits.

#: Words per shingle, 64-bit words of a wide fingerprint, words compared at first, bits of them that may differ.
WIDE_SHINGLE, WIDE, COMPARED, APART = 5, 16, 2, 36
#: Bits of a band, and from one band's start to the next one's: bands overlap by half.
BAND, STEP = 16, 8
#: Bits of the whole wide fingerprint that may differ: arccos(0.8) / pi of them is 210, and one standard deviation (13) more.
FAR = 222
#: Documents of one band value that are compared in one task.
CROWD = 4096
#: Group size up to which pairs are compared for many groups at once.
PAIRS = 24
#: Number of shingles below which only equal fingerprints link.
TINY = 5


def majority(rows: np.ndarray) -> np.ndarray:
    """For each bit position, how many of the rows (n x words) set it: bit-sliced carry-save addition."""
    total = np.zeros(rows.shape[1] * 64, np.int64)
    weight, level = 1, rows
    while len(level):
        carries = []
        while len(level) > 1:
            third = len(level) // 3
            if third:
                a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
                x = a ^ b
                carries.append((a & b) | (x & c))
                level = np.concatenate((x ^ c, level[3 * third :]))
            else:
                carries.append(level[:1] & level[1:2])
                level = level[:1] ^ level[1:2]
        total += weight * np.unpackbits(np.ascontiguousarray(level[0]).view(np.uint8), bitorder="little").astype(np.int64)
        weight *= 2
        level = np.concatenate(carries) if carries else level[:0]
    return total


def wide(text: str | None) -> tuple[np.ndarray, int]:
    """Fingerprint of WIDE 64-bit words over distinct 5-word shingles, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(WIDE, np.int64), 0
    n = WIDE_SHINGLE
    runs = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])
    hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, max(1, len(words) - n + 1)))
    seeds = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    set_ = np.zeros(WIDE * 64, np.int64)
    for at in range(0, len(hashes), SLAB):
        set_ += majority(mixed(hashes[at : at + SLAB, None] ^ seeds[None, :]))
    return np.packbits(set_ * 2 > len(hashes), bitorder="little").view("<i8"), len(hashes)


def _wide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [wide(t.as_py()) for t in b.column(1)]
        flat = pa.array(np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.int64))
        prints = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * WIDE), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), prints, pa.array([n for _, n in found], pa.int64())], ["doc_id", "wide", "n"])


def apart(prints: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Bits that differ between documents a and b (positions, pairwise; one a stands for all)."""
    return np.bitwise_count(prints[a] ^ prints[b]).sum(-1)


def forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> list[int]:
    """Pairs (positions in a and b) of a spanning forest of least cost."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for i in np.argsort(cost, kind="stable").tolist():
        x, y = top(int(a[i])), top(int(b[i]))
        if x != y:
            above[y] = x
            kept.append(i)
    return kept


def near(words: int, limit: int, edges: bool) -> Callable:
    """Of groups (gid, rows of id, `words` words and, for edges, n) the edges (u, v) of a spanning forest of pairs at `limit` bits or fewer, or else the members (gid, id) that have such a partner.

    A pair is an edge only if it passes the test itself. Documents of under TINY shingles are linked only if all their bits agree.
    """

    def cost_of(prints: np.ndarray, n: np.ndarray | None, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        cost = apart(prints, x, y)
        return cost if n is None else np.where((cost > 0) & (np.maximum(n[x], n[y]) < TINY), words * 64 + 1, cost)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gids, groups = b.column(0).to_numpy(), b.column(1)
            rows = groups.flatten().flatten()
            ids = rows[0].to_numpy()
            prints = np.stack([rows[1 + i].to_numpy() for i in range(words)], axis=1).view(np.uint64)
            members = np.diff(groups.offsets.to_numpy())
            of = np.repeat(np.arange(len(members)), members)
            order = np.lexsort((ids, of))  # the same links whatever the order of arrival
            n = rows[1 + words].to_numpy()[order] if edges else None
            ids, prints = ids[order], prints[order]
            few = np.flatnonzero(members[of] <= PAIRS)
            us, vs = [few[:0]], [few[:0]]
            close: list[list[np.ndarray]] = [[few[:0]], [few[:0]], [few[:0]]]
            for d in range(1, min(PAIRS, len(few))):
                pair = np.flatnonzero(of[few[d:]] == of[few[:-d]])
                if not len(pair):
                    break
                x, y = few[pair], few[pair + d]
                cost = cost_of(prints, n, x, y)
                for column, values in zip(close, (x, y, cost), strict=True):
                    column.append(values[cost <= limit])
            x, y, cost = map(np.concatenate, close)
            chosen = forest(x, y, cost) if edges else slice(None)
            us.append(x[chosen])
            vs.append(y[chosen])
            start = np.cumsum(members) - members
            for g in np.flatnonzero(members > PAIRS):
                waiting = np.arange(start[g], start[g] + members[g])
                while len(waiting) > 1:
                    reached, waiting = [waiting[0]], waiting[1:]
                    while reached and len(waiting):
                        at = reached.pop()
                        ok = cost_of(prints[:, :COMPARED], None, at, waiting) <= limit  # bits of a part are bits of the whole
                        if words > COMPARED:
                            left = np.flatnonzero(ok)
                            ok[left] = cost_of(prints, n, at, waiting[left]) <= limit
                        us.append(np.full(int(ok.sum()), at))
                        vs.append(waiting[ok])
                        reached += waiting[ok].tolist()
                        waiting = waiting[~ok]
            u, v = np.concatenate(us), np.concatenate(vs)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])
            else:
                at = np.unique(np.concatenate((u, v)))
                yield pa.RecordBatch.from_arrays([pa.array(gids[of[at]]), pa.array(ids[at])], ["gid", "id"])

    return run


def similar(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, component_id of the documents whose 5-word shingles are similar (cosine of the sets 0.8 or more).

    What a SimHash measures is the cosine: two fingerprints differ in arccos(cosine) / pi of their bits, here in FAR of 1,024
    or fewer. The wide fingerprint is cut into bands of BAND bits. Documents that share a band value meet in a group with COMPARED
    words of their fingerprints; those that differ little from another one there meet again with all words, and only pairs that differ
    in FAR bits or fewer are links. Links are thinned (to a spanning forest a group) after that test, never before it. Bands
    of over CROWD documents are cut into slices, and every slice is compared with every other in a task of its own.

    NULL and empty texts have one fingerprint and are alike; texts of under TINY shingles only link if their fingerprints are
    equal. Equal texts share a node, so copies are never compared. component_id is the least doc_id, NULL if there is none.
    """
    kind = dict(docs.dtypes)["doc_id"]
    prints = written(docs.select("doc_id", "text").mapInArrow(_wide, f"doc_id {kind}, wide array<bigint>, n bigint").withColumn("id", F.xxhash64("wide", "n")), "similar-prints")
    nodes = written(prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.any_value("wide").alias("wide"), F.max("n").alias("n"), F.count("*").alias("copies")), "similar-nodes")
    per = 64 // STEP
    word = lambda i: F.get("wide", i.cast("int"))
    low = lambda j: F.call_function("shiftrightunsigned", word(F.floor(j / per)), (j % per * STEP).cast("int"))
    high = lambda j: F.when(j % per == per - 1, F.shiftleft(word(F.floor(j / per) + 1), STEP)).otherwise(F.lit(0))  # noqa: E731  a band that two words share
    value = lambda j: low(j).bitwiseOR(high(j)).bitwiseAND(F.lit((1 << BAND) - 1))
    keys = F.transform(F.sequence(F.lit(0), F.lit(WIDE * per - 2)), lambda j: F.shiftleft(j.cast("bigint"), 32).bitwiseOR(value(j)))
    banded = nodes.select("id", *(F.get("wide", F.lit(i)).alias(f"w{i}") for i in range(COMPARED)), F.explode(keys).alias("key"))
    sizes = written(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "similar-bands")
    kept = banded.join(sizes, "key")
    row = lambda words, *more: F.collect_list(F.struct("id", *(F.col(f"w{i}") for i in range(words)), *more)).alias("rows")
    light = kept.where(F.col("size") <= CROWD).groupBy("key").agg(row(COMPARED)).select(F.xxhash64("key").alias("gid"), "rows")  # by the key that the join has dealt by
    slices = F.ceil(F.col("size") * 2 / CROWD).cast("int")
    heavy = kept.where(F.col("size") > CROWD).withColumns({"own": F.pmod(F.xxhash64("id"), slices).cast("int"), "other": F.explode(F.sequence(F.lit(0), slices - 1))})
    heavy = heavy.groupBy(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("gid")).agg(row(COMPARED))
    met = written(light.union(heavy).where(F.size("rows") > 1).mapInArrow(near(COMPARED, APART, False), "gid bigint, id bigint"), "similar-met")
    whole = nodes.select("id", "n", *(F.get("wide", F.lit(i)).alias(f"w{i}") for i in range(WIDE)))
    groups = met.join(whole, "id").groupBy("gid").agg(row(WIDE, "n"))
    star = components(groups.mapInArrow(near(WIDE, FAR, True), "u bigint, v bigint"))
    member = star.select(F.col("u").alias("id"), F.col("v").alias("root")).union(star.select(F.col("v"), F.col("v")).distinct())
    roots = member.join(nodes.select("id", "first"), "id").groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("copies"))
    linked = classed(member, roots, "root").select("id", "component_id", F.lit(True).alias("linked"))
    class_ = nodes.select("id", "first", "copies").join(linked, "id", "left").select("id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), "copies")
    return classed(prints.select("doc_id", "id"), class_, "id").select("doc_id", "component_id")


def one_each(docs: DataFrame, grouped_by: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of `docs` for every component that `grouped_by` finds: the one with the least non-null doc_id (of rows equal in doc_id and text any, as its other columns are not compared).

    Rows are told apart by doc_id and text: different texts under one doc_id, or without any, stand for themselves.
    """
    keys = {"k1": F.xxhash64("doc_id"), "k2": F.xxhash64("text")}
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *(k.alias(n) for n, k in keys.items())).alias("doc_id"), "text")
    found = written(grouped_by(named).select("doc_id", "component_id"), "simhash-groups")
    first = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id.k1").alias("_k1"), F.col("doc_id.k2").alias("_k2")).agg(F.count("*").alias("n"))
    first = written(first, "simhash-kept")
    rows = packed(docs, *(k.alias(n) for n, k in keys.items()))
    kept = rows.join(small(first.select("_k1", "_k2")), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_semi")
    return (kept if first.where("n > 1").isEmpty() else kept.dropDuplicates(["k1", "k2"])).select("row.*")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of every component of fingerprints at distance 2 or less; all columns stay."""
    return one_each(docs, grouped)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of every group of similar documents; all columns stay."""
    return one_each(docs, similar)
