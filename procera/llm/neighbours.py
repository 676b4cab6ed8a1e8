"""Nearest neighbours by largest inner product: int8 tiles with error bounds, exact scores, heaps.

Rows with equal vectors form a class that stands for its rows of least vec_id, as many as a
result can hold, so no class is large however often its vector occurs. Queries are cut into
groups, candidates into stripes; a task gets tiles (a group against a stripe), holds the
group and streams the stripe. Vectors are rounded to int8 multiples of a scale of their own.
With x = s q + e, an inner product differs from s s' <q, q'> by at most |e| |x'| + |s q| |e'|
(Cauchy-Schwarz), plus room for rounding. Pairs whose upper bound falls below the query's
least kept score go; the others are scored in double precision, component by component in
order, and the best stay. What leaves a tile is one short list a query; heaps merge a query's
lists. The integer products are made in float32, which holds them exactly up to EXACT
components (beyond, in float64). No pair of rows ever stands in a table.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components take no
part; vectors of another length are no candidates. Rows are told apart by themselves, not by
vec_id: rows that repeat a vec_id are each a query and a candidate. Equal scores go by
vec_id, NULL last. A NULL vec_id is a candidate, never a query. Fewer candidates than asked for:
all of them. An empty table gives no rows. Other columns are not looked at. Scores beyond
double precision are not defined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procera.llm.common import written

NEAREST, EVERY = 20, 20
#: Queries of a group at most, and bytes of them; candidates of a stripe at least and at most; tiles wanted.
GROUP, GROUP_BYTES = 4096, 32 << 20
STRIPE, WIDEST = 2048, 4 << 20
TILES = 128
#: Rows of a product: candidates and queries.
ACROSS, DOWN = 2048, 1024
#: Components up to which sums of int8 products are exact in float32.
EXACT = (1 << 24) // (127 * 127)
#: Stands for a NULL vec_id in comparisons.
LAST = (1 << 63) - 1


class Quantised:
    """int8 form of vectors: x = scale * q + e, with |x|, |scale * q| and |e| rounded up."""

    def __init__(self, x: np.ndarray):
        self.exact = x.astype(np.float64)
        most = np.abs(self.exact).max(1)
        self.scale = most / 127
        q = np.rint(self.exact / most[:, None] * 127)
        self.q = q.astype(np.int8)
        up = 1 + 1e-12
        # relative to the largest component, so that squares neither overflow nor vanish
        unit, part = self.exact / most[:, None], q / 127
        self.norm, self.near, self.err = (np.sqrt((v * v).sum(1)) * up * most for v in (unit, part, unit - part))

    def ints(self, rows: slice) -> np.ndarray:
        return self.q[rows].astype(np.float32 if self.q.shape[1] <= EXACT else np.float64)


class Search:
    """The best candidates so far of each query of a group: scores falling, ties by least id."""

    def __init__(self, vectors: np.ndarray, keep: int):
        self.of = Quantised(vectors)
        n = len(vectors)
        self.keep = keep
        self.score = np.full((n, keep), -np.inf)
        self.id = np.full((n, keep), LAST, np.int64)
        self.cls = np.full((n, keep), -1, np.int64)

    def add(self, vectors: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> None:
        for at in range(0, len(vectors), ACROSS):
            cut = slice(at, at + ACROSS)
            block = Quantised(vectors[cut])
            for low in range(0, len(self.score), DOWN):
                self._tile(slice(low, min(low + DOWN, len(self.score))), block, ids[cut], classes[cut])

    def _tile(self, down: slice, block: Quantised, ids: np.ndarray, classes: np.ndarray) -> None:
        top = block.norm.max()
        ints = self.of.ints(down)
        kind = ints.dtype.type
        by_query = self.of.scale[down]
        room = lambda x: (x * (1 + 1e-6)).astype(kind)
        # all in units of the query's scale and the block's largest norm
        about = ints @ block.ints(slice(None)).T
        about *= (block.scale / top).astype(kind)[None, :]
        norm = self.of.norm[down] / by_query
        err = np.outer(room(self.of.err[down] / by_query), room(block.norm / top))
        err += np.outer(room(self.of.near[down] / by_query), room(block.err / top))
        err += np.outer(room(norm * 2e-6), room(block.norm / top)) + kind(1e-30)
        floor = self.score[down, -1] / by_query / top
        floor = np.where(np.isfinite(floor), floor - np.abs(floor) * 1e-6 - 1e-30, -np.inf).astype(kind)
        if about.shape[1] > self.keep:
            sure = about - err
            at = about.shape[1] - self.keep
            floor = np.maximum(floor, np.partition(sure, at, axis=1)[:, at])
        about += err
        rows, cols = np.nonzero(about >= floor[:, None])
        if not len(rows):
            return
        score = np.zeros(len(rows))
        q, c = self.of.exact[down].T, block.exact.T
        for i in range(len(c)):  # in order, so that a score does not depend on blocks
            score += np.ascontiguousarray(q[i])[rows] * np.ascontiguousarray(c[i])[cols]
        n = down.stop - down.start
        query = np.concatenate((np.repeat(np.arange(n), self.keep), rows))
        score = np.concatenate((self.score[down].ravel(), score))
        id_ = np.concatenate((self.id[down].ravel(), ids[cols]))
        cls = np.concatenate((self.cls[down].ravel(), classes[cols]))
        order = np.lexsort((cls, id_, -score, query))
        start = np.concatenate(([0], np.cumsum(np.bincount(query, minlength=n))))
        kept = order[(start[:-1, None] + np.arange(self.keep)[None, :])]
        self.score[down], self.id[down], self.cls[down] = score[kept], id_[kept], cls[kept]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _searched(keep: int):
    """Rows sorted by tile, queries before candidates, to one row a query: its best classes of the tile, best first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, vectors, search = None, [], [], None

        def result() -> pa.RecordBatch:
            found = search.cls >= 0
            edge = pa.array(np.concatenate(([0], np.cumsum(found.sum(1)))), pa.int32())
            lists = [pa.ListArray.from_arrays(edge, pa.array(x[found])) for x in (search.score, search.id, search.cls)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), *lists], ["query", "score", "id", "cls"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)  # dim, tile, kind
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if low == high:
                    continue
                dim, number, kind = map(int, keys[low])
                if tile != (dim, number):
                    if search:
                        yield result()
                    tile, names, vectors, search = (dim, number), [], [], None
                piece = b.slice(low, high - low)
                x = _matrix(piece.column(5), dim)
                if kind == 0:
                    names.append(piece.column(3).to_numpy())
                    vectors.append(x.copy())
                elif names:
                    search = search or Search(np.concatenate(vectors), keep)
                    search.add(x, piece.column(4).to_numpy(), piece.column(3).to_numpy())
        if search:
            yield result()

    return run


def _merged(keep: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for query, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs = [zip((-s for s in x["score"]), x["id"], x["cls"], strict=True) for x in lists]
                rows += [(query, -s, cls) for s, _, cls in islice(heapq.merge(*runs), keep)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["query", "score", "cls"])

    return run


def usable(vector: F.Column) -> F.Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def search(embeddings: DataFrame, is_query: F.Column, nearest: int = NEAREST) -> DataFrame:
    """Per query row (those of `is_query`, a condition on vec_id) its `nearest` other rows: query_id, rank (from 1), vec_id, score."""
    keep = nearest + 1  # one more, as a query's own row is among them
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector")).where(usable(F.col("vector")))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.xxhash64("vector").alias("hash"), F.coalesce(is_query, F.lit(False)).alias("asks")), "neighbours-rows")
    place = F.row_number().over(Window.partitionBy("hash", "vector").orderBy(F.asc_nulls_last("vec_id"), "row"))
    listed = rows.withColumn("place", place).where(F.col("place") <= keep)
    members = F.array_sort(F.collect_list(F.struct("place", "vec_id", "row")))
    classes = listed.groupBy("hash", "vector").agg(members.alias("members"))
    classes = written(classes.select(F.col("members")[0]["row"].alias("cls"), F.coalesce(F.col("members")[0]["vec_id"], F.lit(LAST)).alias("id"), "hash", "vector", "members"), "neighbours-classes")
    asked = rows.where("asks")
    asking = written(classes.join(asked.select("hash", "vector").distinct(), ["hash", "vector"], "left_semi").select("cls", "id", "vector"), "neighbours-queries")
    n, dim = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_asking = asking.count()
    group = max(64, min(GROUP, GROUP_BYTES // (8 * (dim or 1))))
    groups = max(1, -(-n_asking // group))
    stripes = max(1, min(-(-n // STRIPE), max(-(-TILES // groups), -(-n // WIDEST))))
    tile = lambda g, s: (g * stripes + s).cast("bigint").alias("tile")
    part = lambda c, seed, m: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m))
    columns = lambda kind: (F.lit(kind).cast("bigint").alias("kind"), "cls", "id", "vector")
    dims = F.size("vector").cast("bigint").alias("dim")
    queries = asking.withColumns({"g": part("cls", 1, groups), "s": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))})
    candidates = classes.withColumns({"s": part("cls", 2, stripes), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    sides = queries.select(dims, tile(F.col("g"), F.col("s")), *columns(0)).union(candidates.select(dims, tile(F.col("g"), F.col("s")), *columns(1)))
    dealt = sides.repartition(min(groups * stripes, 50_000), "dim", "tile").sortWithinPartitions("dim", "tile", "kind")
    lists = dealt.mapInArrow(_searched(keep), "query bigint, score array<double>, id array<bigint>, cls array<bigint>")
    best = lists.groupBy("query").agg(F.collect_list(F.struct("score", "id", "cls")).alias("lists")).mapInArrow(_merged(keep), "query bigint, score double, cls bigint")
    found = best.join(classes.select("cls", "members"), "cls").select("query", "score", F.explode("members").alias("m"))
    ordered = F.struct((-F.col("score")).alias("below"), F.col("m.vec_id").isNull().alias("unnamed"), F.col("m.vec_id").alias("vec_id"), F.col("m.row").alias("row"), "score")
    hits = written(found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(ordered)), 1, keep).alias("hits")), "neighbours-hits")
    keyed = hits.join(classes.select(F.col("cls").alias("query"), "hash", "vector"), "query").select("hash", "vector", "hits")
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("row")), 1, nearest)
    ranked = asked.join(keyed, ["hash", "vector"]).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """The search with every `every`-th vec_id as queries."""
    return search(embeddings, F.col("vec_id") % every == 0)


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM o WHERE k <= {NEAREST}"""
