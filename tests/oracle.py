"""Side-by-side comparison of a Spark query with its DuckDB text."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


def duck(sf_dir, sql, **extra):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, table in extra.items():
        db.register(name, table)
    got = db.sql(sql)
    return canonical(got.columns, got.fetchall())


def compare(df, sf_dir, sql):
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = duck(sf_dir, sql)
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == b
