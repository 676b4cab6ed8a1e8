from collections import defaultdict

import pytest
import xxhash

from procera.llm import simhash
from procera.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[find(i)].append(d)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((d, f"{f:016x}", ids[find(i)]) for i, (d, f) in enumerate(prints)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert result(QUERIES["op6_simhash"](spark, SF)) == brute([tuple(r) for r in docs.collect()])


def test_edge_rows(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (5, None), (4, ""), (7, " \n\t "), (8, "Ünï Ä"), (9, "one"), (10, "ONE"), (None, "only null id here now")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    assert result(simhash.report(docs)) == brute(rows)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect() if r.doc_id is not None) == [3, 4, 8, 9]
    assert simhash.report(docs.limit(0)).count() == 0


def test_crowded_classes_join_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 9) for i in range(60)] + [(60, None), (61, 77)], "doc_id long, key long")
    class_ = spark.createDataFrame([(k, 10 * k if k else None, 30 if k == 9 else 5) for k in (0, 1, 2, 3, 4, 5, 6, 9)], "key long, component_id long, copies long")
    want = result(rows.join(class_, "key").select("doc_id", "component_id"))
    for most in (1, 3, 1000):  # all shuffled, one key broadcast, all broadcast
        monkeypatch.setattr(simhash, "HOT", most)
        assert result(simhash.classed(rows, class_, "key").select("doc_id", "component_id")) == want
        assert simhash.classed(rows, class_.limit(0), "key").count() == 0


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 3)
    fps = [0] + [1 << i for i in range(40)] + [(1 << i) | (1 << 50) for i in range(12)] + [7 << 20, 31 << 30]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = {(min(r), max(r)) for r in simhash.links(frame).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert (a ^ b).bit_count() <= 2
        parent[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)


def test_similar_documents_are_found_in_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 4)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(6):
        base = words[g * 300 : g * 300 + 120]
        for k in range(3 + 4 * g):
            copy = list(base)
            copy[5 + k] = f"edit{g}x{k}"
            rows.append((100 * g + k, " ".join(copy)))
    rows += [(5000 + i, " ".join(words[2000 + 90 * i : 2090 + 90 * i])) for i in range(20)] + [(None, None), (9000, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c == (9000 if d in (None, 9000) else d if d >= 5000 else d // 100 * 100) for d, c in got.items())


def test_majority_counts_bits():
    import numpy as np

    rows = np.random.default_rng(0).integers(0, 1 << 63, (77, 3), dtype=np.uint64)
    want = [sum(int(w) >> b & 1 for w in rows[:, i]) for i in range(3) for b in range(64)]
    assert simhash.majority(rows).tolist() == want


def test_crowded_bands_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 1)
    rows = []
    for g in range(40):
        base = [f"w{g}x{i}" for i in range(200)]
        copy = [f"e{i}" if i in (30, 80, 130, 170) else x for i, x in enumerate(base)]  # similarity 176 of 216 shingles
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(40)) >= 38


@pytest.mark.parametrize("pairs", [100, 6000])
def test_pairs_among_boilerplate_are_found_at_any_size(spark, pairs):
    """Any two documents share 65 % of their shingles, true pairs 84 %: neither the corpus' size nor its other links hide a pair."""
    import random

    r = random.Random(pairs)
    words = lambda n: [f"{r.randrange(1 << 40):x}" for _ in range(n)]
    shared = words(195)
    rows = []
    for i in range(pairs):
        both = words(57)
        rows += [(2 * i + k, " ".join(shared + both + words(48))) for k in (0, 1)]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] for i in range(pairs)) / pairs
    print("recall", pairs, found, "components", len(set(got.values())))
    assert found >= 0.95
    assert len(set(got.values())) >= 0.9 * pairs  # and unlike documents stay apart
