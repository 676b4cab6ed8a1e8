"""The blocked search against every pair, bit for bit."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from procera.llm import neighbours
from procera.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def plain(rows, every, nearest):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    kept = [(i, v) for i, v in rows if ok(v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % every:
            continue
        found = sorted((-dot(v, w), j is None, j or 0, j) for b, (j, w) in enumerate(kept) if a != b and len(w) == len(v))[:nearest]
        out += [(i, k + 1, j, -s) for k, (s, _, _, j) in enumerate(found)]
    return sorted(out, key=str)


def check(spark, rows, every=3, nearest=5):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    got = neighbours.search(df, F.col("vec_id") % every == 0, nearest)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, every, nearest)


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed, monkeypatch):
    for name, value in (("ACROSS", 37), ("DOWN", 11), ("STRIPE", 60), ("GROUP", 64)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(seed)
    size = 10 ** r.uniform(-3, 3, 300)
    check(spark, [(i, (r.normal(size=9) * size[i]).astype(np.float32).tolist()) for i in range(300)])


def test_copies_near_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ACROSS", 16)
    r = np.random.default_rng(5)
    hot = r.normal(size=8).astype(np.float32)
    rows = [(i, hot.tolist()) for i in range(0, 120)] + [(200 + i, (hot * np.float32(1 + 1e-6 * (i % 7))).tolist()) for i in range(80)]
    rows += [(400 + i, [float(i % 3), 0.0, 1.0, -0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(50)]
    check(spark, rows, every=10, nearest=20)


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [2.0, 1.0]), (None, [5.0, 5.0]), (None, [5.0, 5.0]), (6, [1.0]), (9, [2.0]), (12, None), (15, []), (18, [0.0, 0.0]), (21, [nan, 1.0]), (24, [inf, 1.0]), (27, [None, 1.0]), (-3, [-1.0, -1.0])]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [(12, None)])


def test_large_and_tiny_values(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=4) * 10.0 ** r.choice([-40, -20, 0, 18, 36])).astype(np.float32).tolist()) for i in range(120)]
    check(spark, rows, every=2, nearest=7)


def test_many_components_and_doubles(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=1500).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 4 == 0, 3).collect()))
    want = []
    for i, v in rows[::4]:
        scored = []
        for j, w in rows:
            total = 0.0
            for x, y in zip(v, w, strict=True):
                total += x * y
            scored += [(-total, j)] * (i != j)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted(scored)[:3])]
    assert got == want


def test_scores_equal_sql_to_the_last_bit(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op13_neighbours"](spark, sf).collect())) == sorted(duckdb.sql(neighbours.ORACLE).fetchall())
