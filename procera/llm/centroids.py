"""Centroid clustering with Drake's adaptive bounds, in exact integer arithmetic.

Beside its centroid a vector carries an upper bound of the distance to it, its next nearest
centroids in order with a lower bound for each, and one remainder bound for all other centroids.
When centroids move, bounds move by as much. Where the upper bound lies below all lower ones
the assignment stands without a look at any centroid; where it lies below the remainder and
all but the first few lower bounds, only those few are measured; where the order cannot be certified, all
centroids are. Bounds only ever save work: what decides are exact squared distances, ties going to
the smaller number. The number of lower bounds starts at a quarter of the centroids and shrinks
to what the last round needed (an eighth at least).

A round is one pass over a table of vectors and bounds, written for the next; sums per
centroid are Spark aggregates with partial sums, so a centroid that holds a third of all
vectors is as cheap as any. The driver holds the centroids and nothing else.

Defined results: vectors that are NULL, of another length or hold NULL or non-finite components take no part.
Components become floor(scale * x), at most 2**27 in size (larger ones are cut to that, so that
squared distances fit a long). First centroids: the vectors with the least hash of vec_id;
rows that share a vec_id go by their components, NULL ids last; fewer vectors than centroids: as many
centroids as vectors. Equal centroids leave the later ones empty; empty ones stay where they are. Rows that repeat a
vec_id are clustered each for itself. Sums beyond a long are NULL. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import mark, release, written

CENTROIDS, ROUNDS, SCALE, COMPONENTS, SEED = 40, 5, 256, 64, 2
#: Largest component, and largest for which float64 products are exact.
LARGEST, EXACT = 1 << 27, 1 << 20
#: Room for rounding in bounds, relative and absolute; squared distances are integers, so different ones lie further apart.
NEARLY, ROOM = 1e-9, 1e-6
#: Vectors measured at a time.
SLAB = 8192


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (n x k, int64) of vectors to centroids."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


class Bounds:
    """Assignment and bounds of vectors. `low` bounds the distance to centroid `near` (in order), `rest` that to all not named."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.near, self.low, self.rest = cluster, upper, near, low, rest
        #: Lower bounds that were of no use: 0 where bounds alone decided, over their number where all centroids were measured.
        self.needed = np.zeros(len(cluster), np.int32)

    @classmethod
    def measured(cls, v: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        """All centroids, the b next nearest named."""
        d = squared(v, c)
        order = np.argsort(d, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(d, order[:, : b + 2], 1))
        rest = far[:, b + 1] if far.shape[1] > b + 1 else np.full(len(v), np.inf)
        return cls(order[:, 0].astype(np.int32), far[:, 0], order[:, 1 : b + 1].astype(np.int32), far[:, 1 : b + 1], rest)

    def narrowed(self, b: int) -> None:
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b].copy(), self.low[:, :b].copy()

    def moved(self, drift: np.ndarray) -> None:
        self.upper = self.upper + drift[self.cluster]
        self.low = self.low - drift[self.near]
        self.rest = self.rest - drift.max(initial=0)

    def place(self, rows: np.ndarray, other: Bounds) -> None:
        for name in ("cluster", "upper", "near", "low", "rest"):
            getattr(self, name)[rows] = getattr(other, name)

    def reassign(self, v: np.ndarray, c: np.ndarray) -> None:
        b = self.near.shape[1]
        beyond = np.minimum.accumulate(np.concatenate((self.low, self.rest[:, None]), axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self._unsure(self.upper, beyond[:, 0]))
        self.upper[open_] = np.sqrt(((v[open_] - c[self.cluster[open_]]) ** 2).sum(1))
        open_ = open_[self._unsure(self.upper[open_], beyond[open_, 0])]
        sure = ~self._unsure(self.upper[open_, None], beyond[open_])
        first = np.where(sure.any(1), sure.argmax(1), b + 1)
        self.needed[open_] = first
        for z in range(1, b + 1):
            rows = open_[first == z]
            if len(rows):
                names = np.concatenate((self.cluster[rows, None], self.near[rows, :z]), axis=1)
                d = ((v[rows, None, :] - c[names]) ** 2).sum(2)
                order = np.lexsort((names, d), axis=1)
                names, far = np.take_along_axis(names, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
                self.cluster[rows], self.upper[rows] = names[:, 0], far[:, 0]
                self.near[rows, :z], self.low[rows, :z] = names[:, 1:], far[:, 1:]
        rows = open_[first > b]
        if len(rows):
            self.place(rows, Bounds.measured(v[rows], c, b))

    @staticmethod
    def _unsure(upper: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        return upper * (1 + NEARLY) + ROOM >= beyond * (1 - NEARLY) - ROOM


def _assigned(c: np.ndarray, drift: np.ndarray | None, b: int):
    """Batches (vec_id, v) or of a previous pass to (vec_id, v, cluster, distance, needed, upper, near, low, rest)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                piece = batch.slice(at, SLAB)
                n = piece.num_rows
                flat = lambda name: piece.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)  # noqa: E731, B023
                v = flat("v").astype(np.int64)
                if drift is None:
                    state = Bounds.measured(v, c, b)
                else:
                    one = lambda name: piece.column(name).to_numpy(zero_copy_only=False).copy()  # noqa: E731, B023
                    near = flat("near") if len(piece.column("near").flatten()) else np.zeros((n, 0), np.int32)
                    low = flat("low") if near.shape[1] else np.zeros((n, 0))
                    state = Bounds(one("cluster"), one("upper"), near.copy(), low.copy(), one("rest"))
                    state.narrowed(b)
                    state.moved(drift)
                    state.reassign(v, c)
                distance = ((v - c[state.cluster]) ** 2).sum(1)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), piece.column("v"), pa.array(state.cluster, pa.int32()), pa.array(distance), pa.array(state.needed), pa.array(state.upper), lists(state.near, pa.int32()), lists(state.low, pa.float64()), pa.array(state.rest)],
                    ["vec_id", "v", "cluster", "distance", "needed", "upper", "near", "low", "rest"],
                )

    return run


def whole(embeddings: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v): vectors that take part, as integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = embeddings.select("vec_id", F.col("embedding").alias("e")).where((F.size("e") == components) & F.forall("e", finite))
    cut = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return kept.select("vec_id", F.transform("e", cut).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and needed (see Bounds)."""
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)["vec_id"]
    since = mark()
    vectors = written(whole(embeddings, scale, components), "centroids-vectors")
    c = first_centroids(vectors, k, seed)
    if not len(c):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, needed int")
    b, drift, state = min(max(1, k // 4), len(c) - 1), None, vectors
    schema = f"vec_id {kind}, v array<int>, cluster int, distance bigint, needed int, upper double, near array<int>, low array<double>, rest double"
    for _ in range(rounds):
        state = written(state.mapInArrow(_assigned(c, drift, b), schema), "centroids-state")
        release(spark, since, last=1)
        sums = [F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(components)]
        found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("needed").alias("needed"), *sums).collect()  # a row a centroid
        moved = c.copy()
        for row in found:
            moved[row.cluster] = [row[f"s{i}"] // row.n for i in range(components)]
        if drift is not None:
            b = min(b, max(k // 8, *(r.needed for r in found)))
        drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + NEARLY)
        c = moved
    state = written(state.mapInArrow(_assigned(c, drift, b), schema), "centroids-state")
    release(spark, since, last=1)
    inertia = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    total = None if None in inertia.values() or sum(inertia.values()) > (1 << 63) - 1 else sum(inertia.values())
    named = [(i, d, total, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, d in inertia.items()]
    told = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))  # a row a centroid
    return state.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "needed")


def _oracle() -> str:
    moved = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(greatest(least(floor({SCALE} * CAST(x AS DOUBLE)), {LARGEST}), -{LARGEST}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {COMPONENTS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "x AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
        f"f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c FROM v)",
        f"c0 AS (SELECT c, i, x AS m FROM f JOIN x USING (r) WHERE c < {CENTROIDS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT r, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{k} USING (i) GROUP BY r, c)")
        steps.append(f"a{k} AS (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{k} GROUP BY r)")
        if k < ROUNDS:
            steps.append(f"n{k} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY c, i)")
            steps.append(f"c{k + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE {moved} END AS m FROM c{k} LEFT JOIN n{k} USING (c, i))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)")
    return f"""WITH {", ".join(f"{s[: s.index(' AS ')]} AS MATERIALIZED {s[s.index(' AS ') + 4 :]}" for s in steps)}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM v JOIN a{ROUNDS} USING (r) JOIN h USING (c)"""


ORACLE = _oracle()
