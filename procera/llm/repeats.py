"""Windows of fixed length that occur more than once in a corpus, as spans per document.

Shared by the byte-level and the word-level operator. Steps, all over runs of
windows (see `runs`):

1. count minimiser keys; keys seen once hold no repeated window;
2. list the runs under recurring keys; a run whose whole content recurs is
   repeated throughout;
3. runs that share a key with different runs are contested: one representative
   of each distinct one is fetched and decided by the operator's own method among
   the runs of its key. Where over MOST different ones meet, they are narrowed to
   blocks of fewer windows around a longer common core, under which again equal
   blocks are repeated throughout and different ones are contested, down to single
   windows, where none differ: no group is unbounded and none is left out;
4. verdicts reach all occurrences by a join and become spans per document.

Steps 2 and 3 scan the documents again and emit only rows that a sieve lets through:
a bitmap of SLOTS bits, whatever the input, and behind it, where over a quarter of its
bits are set, a semi-join with the wanted values. A slot shared by chance lets a row
through that a later join drops.

Defined results: NULL and empty texts have no windows; rows equal in doc_id and text
are copies of each other and get equal spans, each span kept once; an empty
table has no spans; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import written
from procera.llm.runs import Runs, mixed, runs

#: Bits of the broadcast bitmap (16 MB), bits per row of its table, and set bits beyond which a semi-join follows.
SLOTS = 1 << 27
PAGE = 1 << 15
FULL = SLOTS // 4
#: Distinct contents under one name that one task compares.
MOST = 256
#: Bytes of groups that are judged at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Text:
    """A text's symbols (mixed 64-bit values) and the bytes behind them: symbols i to j are data[edge[i] : edge[j] - gap]."""

    symbols: np.ndarray
    data: bytes
    edge: np.ndarray | None = None
    gap: int = 0

    def contents(self, found: Runs, window: int) -> list[bytes]:
        """What each run's windows cover."""
        a, b = found.start, found.start + found.count + window - 1
        if self.edge is not None:
            a, b = self.edge[a], self.edge[b] - self.gap
        return [self.data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


@dataclass(frozen=True)
class Piece:
    """`count` consecutive windows of one distinct run whose minimiser stands `left` symbols after the first one's start."""

    body: bytes
    count: int
    left: int


@dataclass(frozen=True)
class Spec:
    """What a symbol is, and the operator's method.

    `items` gives a body's symbols as a sequence that `whole` turns into bytes again; `judge(width)` finds, among the pieces
    of each of several groups, the (piece, offset) of windows that occur twice or more in their group, where pieces have
    blocks of up to `width` windows. `widths` are the blocks' lengths, widest first, the last one 1.
    """

    window: int
    gram: int
    read: Callable[[str | None], Text]
    items: Callable[[bytes], list | bytes]
    whole: Callable[[list | bytes], bytes]
    widths: tuple[int, ...]
    judge: Callable[[list[list[Piece]], int], list[tuple[int, int, int]]]


def blocks(items, count: int, left: int, width: int, window: int) -> Iterator[tuple]:
    """(place, first, windows, left, start of the core, items) of a piece's blocks of up to `width` windows.

    Windows are named by their distance to the minimiser, which falls from `left`, and blocks begin at multiples of `width`
    of it: equal windows stand in blocks of one place. All windows of a block share a core of window - width + 1 symbols.
    """
    last = left - count + 1
    for q in range(last // width, left // width + 1):
        far, near = min(left, q * width + width - 1), max(last, q * width)
        yield q, left - far, far - near + 1, far, far - q * width, items[left - far : left - near + window]


def tagged(docs: DataFrame) -> DataFrame:
    """`k1`, `k2` name a row by its doc_id and text; rows equal in both need equal spans."""
    return docs.withColumns({"k1": F.xxhash64("doc_id"), "k2": F.xxhash64("text")})


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, parts)), np.int64)


def place_id(k1: int, k2: int, start: np.ndarray) -> np.ndarray:
    """A number for an occurrence, the same whenever it is computed."""
    doc = np.array([k1, k2], np.int64).view(np.uint64)
    return mixed(mixed(doc[:1]) ^ mixed(doc[1:] + np.uint64(1)) + start.astype(np.uint64)).view(np.int64)


def key_counts(docs: DataFrame, spec: Spec) -> DataFrame:
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r.key for t in b.column(0) if (r := runs(spec.read(t.as_py()).symbols, spec.window, spec.gram))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(emit, "key bigint").groupBy("key").agg(F.count("*").alias("n"))


def hit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.uint64) & np.uint64(SLOTS - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Sieve:
    """The values of a column, as a broadcast bitmap of their slots built on the executors in pages; `rows` must be written.

    A bitmap with over FULL bits set holds little back: `behind` then puts a semi-join with the values after it.
    """

    def __init__(self, rows: DataFrame, column: str):
        slot = F.col(column).bitwiseAND(F.lit(SLOTS - 1))
        pages = rows.select(F.floor(slot / PAGE).cast("int").alias("page"), (slot % PAGE).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
        whole = np.zeros(SLOTS // 8, np.uint8)
        for page, bits in pages.toLocalIterator():
            whole[page * (PAGE // 8) : (page + 1) * (PAGE // 8)] = np.frombuffer(bits, np.uint8)
        self.values = rows.select(F.col(column).alias("_v")).distinct() if int(np.bitwise_count(whole).sum()) > FULL else None
        self.bits = rows.sparkSession.sparkContext.broadcast(whole)

    def behind(self, emitted: DataFrame, column: str) -> DataFrame:
        if self.values is None:
            return emitted
        return emitted.join(self.values, F.col(column) == F.col("_v"), "left_semi")


def listed(docs: DataFrame, spec: Spec, recurring: Sieve) -> DataFrame:
    """Occurrences of runs under recurring keys: key, h (content hash), k1, k2, start, count, place."""
    kept = recurring.bits

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                read = spec.read(text.as_py())
                r = runs(read.symbols, spec.window, spec.gram)
                if r is None:
                    continue
                r = r.where(hit(kept.value, r.key))
                n = len(r.start)
                if n:
                    row = (r.key.view(np.int64), hashes(read.contents(r, spec.window)), np.full(n, k1), np.full(n, k2), r.start, r.count, place_id(k1, k2, r.start))
                    for column, values in zip(out, row, strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["key", "h", "k1", "k2", "start", "count", "place"])

    rows = docs.select("k1", "k2", "text").mapInArrow(emit, "key bigint, h bigint, k1 bigint, k2 bigint, start bigint, count bigint, place bigint")
    return recurring.behind(rows, "key")


def fetched(docs: DataFrame, spec: Spec, places: Sieve) -> DataFrame:
    """The chosen occurrences with their content: key, h, place, count, left (windows before the minimiser's own start), body."""
    kept = places.bits

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies: list[bytes] = []
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                read = spec.read(text.as_py())
                r = runs(read.symbols, spec.window, spec.gram)
                if r is None:
                    continue
                place = place_id(k1, k2, r.start)
                keep = hit(kept.value, place)
                if keep.any():
                    r = r.where(keep)
                    parts = read.contents(r, spec.window)
                    for column, values in zip(out, (r.key.view(np.int64), hashes(parts), place[keep], r.count, r.at - r.start), strict=True):
                        column.append(values)
                    bodies += parts
            if bodies:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x), pa.int64()) for x in out), pa.array(bodies, pa.binary())], ["key", "h", "place", "count", "left", "body"])

    rows = docs.select("k1", "k2", "text").mapInArrow(emit, "key bigint, h bigint, place bigint, count bigint, left bigint, body binary")
    return places.behind(rows, "place").drop("place")


PIECE = "struct<key:bigint,h:bigint,first:bigint,count:bigint,left:bigint,body:binary>"


def judged(groups: DataFrame, spec: Spec, width: int) -> DataFrame:
    """(key, h, at, n): ranges of repeated windows in the runs of each (bounded) group of different pieces."""

    def ranges(owners: list[list[tuple[int, int, int]]], pieces: list[list[Piece]]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        before = None
        for g, i, at in sorted(spec.judge(pieces, width)):
            key, h, first = owners[g][i]
            if before == (g, i, at - 1):
                out[-1] = (*out[-1][:3], out[-1][3] + 1)
            elif before != (g, i, at):
                out.append((key, h, first + at, 1))
            before = (g, i, at)
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "h", "at", "n"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners: list[list[tuple[int, int, int]]] = []
            pieces: list[list[Piece]] = []
            size = 0
            for group in b.column(0):
                rows = group.as_py()
                owners.append([(x["key"], x["h"], x["first"]) for x in rows])
                pieces.append([Piece(x["body"], x["count"], x["left"]) for x in rows])
                size += sum(len(x["body"]) for x in rows)
                if size > AT_ONCE:
                    yield ranges(owners, pieces)
                    owners, pieces, size = [], [], 0
            yield ranges(owners, pieces)

    return groups.mapInArrow(emit, "key bigint, h bigint, at bigint, n bigint")


def narrowed(pieces: DataFrame, spec: Spec, width: int) -> DataFrame:
    """Blocks of up to `width` windows of the pieces: name (128 bits of old name, place and core), t (128 bits of the content), piece."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ts, out = [], [], []
            for name, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = x.as_py()
                items = spec.items(row["body"])
                for q, first, count, left, core, part in blocks(items, row["count"], row["left"], width, spec.window):
                    body = spec.whole(part)
                    names.append(xxhash.xxh3_128_digest(b"%b %d %b" % (name, q, spec.whole(part[core : core + spec.window - width + 1]))))
                    ts.append(xxhash.xxh3_128_digest(body))
                    out.append(row | {"first": row["first"] + first, "count": count, "left": left, "body": body})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ts, pa.binary()), pa.array(out, b.column(1).type)], ["name", "t", "piece"])

    return pieces.select("name", "piece").mapInArrow(emit, f"name binary, t binary, piece {PIECE}")


def settled(bodies: DataFrame, spec: Spec, name: str) -> DataFrame:
    """(key, h, at, n): ranges of windows that occur in several of the distinct runs (key, h, count, left, body)."""
    piece = F.struct("key", "h", F.lit(0).cast("bigint").alias("first"), "count", "left", "body").alias("piece")
    now = bodies.select(F.encode(F.col("key").cast("string"), "UTF-8").alias("name"), piece)
    found = None
    # The first round takes whole runs, their blocks being cut inside the judge.
    for i, width in enumerate((spec.widths[0], *spec.widths)):
        size = written(now.groupBy("name").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-sizes")
        sized = written(now.join(size, "name"), f"{name}-sized")
        few = sized.where(F.col("size") <= MOST).groupBy("name").agg(F.collect_list("piece").alias("pieces")).select("pieces")
        part = judged(few, spec, width)
        found = part if found is None else found.union(part)
        crowded = sized.where(F.col("size") > MOST)
        if i == len(spec.widths) or crowded.isEmpty():
            return found
        blocks_ = written(narrowed(crowded, spec, spec.widths[i]), f"{name}-blocks")
        held = written(blocks_.groupBy("name", "t").agg(F.count("*").alias("n"), F.min(F.struct("piece.key", "piece.h", "piece.first")).alias("one")), f"{name}-held")
        joined = blocks_.join(held, ["name", "t"])
        # Equal blocks of several runs are repeated throughout: a plan of its own, whose skew Spark splits.
        found = found.union(written(joined.where("n > 1").select("piece.key", "piece.h", F.col("piece.first").alias("at"), F.col("piece.count").alias("n")), f"{name}-equal"))
        now = written(joined.where(F.struct("piece.key", "piece.h", "piece.first") == F.col("one")).select("name", "piece"), f"{name}-now")
    return found


def spans(docs: DataFrame, spec: Spec, name: str) -> DataFrame:
    """(k1, k2, spans): symbol ranges, possibly overlapping, that repeated windows cover. Rows of `docs` must be `tagged`."""
    keys = written(key_counts(docs, spec).where("n > 1").select("key"), f"{name}-keys")
    seen = written(listed(docs, spec, Sieve(keys, "key")), f"{name}-runs")
    distinct = written(seen.groupBy("key", "h").agg(F.count("*").alias("n"), F.min("place").alias("place")), f"{name}-distinct")
    variants = distinct.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1")
    contested = written(distinct.join(variants, "key").select("key", "h", "n", "place"), f"{name}-contested")
    bodies = fetched(docs, spec, Sieve(contested, "place")).dropDuplicates(["key", "h"]).join(contested.select("key", "h"), ["key", "h"])
    part = settled(written(bodies, f"{name}-bodies"), spec, name).join(contested.where("n = 1").select("key", "h"), ["key", "h"], "left_semi")
    part = part.groupBy("key", "h").agg(F.collect_list(F.struct("at", "n")).alias("dup"))
    whole = distinct.where("n > 1").select("key", "h", F.lit(None).cast("array<struct<at:bigint,n:bigint>>").alias("dup"))
    occurrences = seen.select("key", "h", "k1", "k2", "start", "count").join(whole.union(part), ["key", "h"])
    all_of_it = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("count") + spec.window - 1).alias("b")))
    some_of_it = F.transform("dup", lambda d: F.struct((F.col("start") + d["at"]).alias("a"), (F.col("start") + d["at"] + d["n"] + spec.window - 1).alias("b")))
    per_run = occurrences.select("k1", "k2", F.when(F.col("dup").isNull(), all_of_it).otherwise(some_of_it).alias("s"))
    return per_run.groupBy("k1", "k2").agg(F.flatten(F.collect_set("s")).alias("spans"))


def merged(ranges: list | None, total: int) -> np.ndarray:
    """Maximal disjoint ranges, as rows (start, end)."""
    if not ranges:
        return np.zeros((0, 2), np.int64)
    r = np.array([(x["a"], x["b"]) for x in ranges], np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    first = np.concatenate(([True], r[1:, 0] > reach[:-1]))
    starts = r[first, 0]
    ends = reach[np.append(np.flatnonzero(first)[1:] - 1, len(r) - 1)]
    return np.stack((starts, np.minimum(ends, total)), axis=1)


def gaps(removed: np.ndarray, total: int) -> list[tuple[int, int]]:
    """What the removed ranges leave."""
    edges = [0, *removed.ravel().tolist(), total]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
