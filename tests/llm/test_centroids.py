"""Drake's bounds against plain rounds, on hand-made and random vectors."""

import hashlib

import numpy as np
import pytest

from procera.llm import centroids
from procera.llm.centroids import Bounds, clustered, squared

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def plain(vectors, k, rounds, seed=2):
    """(cluster, distance) by full scans; `vectors` are (id, list of integers)."""
    first = sorted(vectors, key=lambda x: (hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest() if x[0] is not None else "~", x[1]))[:k]
    c = [list(v) for _, v in first]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(c)) for _, v in vectors]
        if step < rounds:
            for i in range(len(c)):
                mine = [v for (_, v), (_, at) in zip(vectors, near, strict=True) if at == i]
                if mine:
                    c[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, d) for d, i in near], c


def check(spark, rows, k, rounds, components, scale=256):
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    got = clustered(df, k, rounds, scale, components).collect()
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    want, c = plain(kept, k, rounds)
    told = lambda i: hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest()
    total = sum(d for _, d in want)
    per = {}
    for i, d in want:
        per[i] = per.get(i, 0) + d
    expected = [(n, i, d, per[i], total, told(i)) for (n, _), (i, d) in zip(kept, want, strict=True)]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(expected, key=str)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_equals_full_scans(spark, seed):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(25, 6))
    rows = [(i, (middle[i % 25] + r.normal(size=6) * 0.3).astype(np.float32).tolist()) for i in range(1200)]
    got = check(spark, rows, 24, 7, 6)
    assert any(x.needed for x in got) and sum(x.needed == 0 for x in got) > len(got) / 4  # bounds decide many, and not all


def test_ties_copies_and_what_takes_no_part(spark):
    hot = [1.0, 0.5, 0.0]
    rows = [(i, hot) for i in range(60)] + [(100 + i, [float(i % 4), 0.0, 1.0]) for i in range(40)] + [(7, [0.25, 0.25, 0.25]), (7, [0.75, 0.25, 0.25]), (None, [3.0, 3.0, 3.0])]
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 0.0]), (504, [float("nan"), 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0]), (506, [-0.001, -5.5, 0.0])]
    check(spark, rows, 10, 5, 3)
    check(spark, rows[:3], 10, 5, 3)  # fewer vectors than centroids, all equal
    check(spark, [(1, [1e30, -1e30, 0.0][:3]), (2, [0.0, 0.0, 0.0])][1:], 10, 2, 3)


def test_huge_components_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38], 0, "", 0), (2, [0.0, 0.0], 0, "", 0)], SCHEMA)
    assert {r.vec_id: r.distance for r in clustered(df, 1, 0, components=2).collect()} in ({1: 0, 2: 2 * centroids.LARGEST**2}, {2: 0, 1: 2 * centroids.LARGEST**2})
    empty = clustered(df.limit(0), components=2)
    assert empty.isEmpty() and empty.columns == clustered(df, 1, 1, components=2).columns


def test_exact_beyond_float(spark):
    r = np.random.default_rng(1)
    v, c = r.integers(-centroids.LARGEST, centroids.LARGEST, (50, 8)), r.integers(-centroids.LARGEST, centroids.LARGEST, (9, 8))
    assert squared(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]


def test_bounds_hold_after_every_round():
    r = np.random.default_rng(3)
    v, c = r.integers(-500, 500, (400, 5)), r.integers(-500, 500, (16, 5))
    state = Bounds.measured(v, c, 4)
    for step in range(8):
        moved = c + r.integers(-40, 40, c.shape) // (step + 1)
        drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + centroids.NEARLY)
        c = moved
        state.narrowed(4 - step // 3)
        state.moved(drift)
        state.reassign(v, c)
        d = np.sqrt(squared(v, c))
        assert (state.cluster == squared(v, c).argmin(1)).all() and (state.upper >= d[np.arange(400), state.cluster] - 1e-6).all()
        named = np.zeros(d.shape, bool)
        np.put_along_axis(named, state.near, True, 1)
        assert (state.low <= np.take_along_axis(d, state.near, 1) + 1e-6).all()
        named[np.arange(400), state.cluster] = True
        assert (np.where(named, np.inf, d).min(1) >= state.rest - 1e-6).all()
