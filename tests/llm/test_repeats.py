import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from procera.llm import repeats, substring, suffixes
from procera.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\v\f\r"


def split(text):
    return "".join(" " if c in BLANKS else c for c in text or "").split(" ")


def covered(items, counts, w):
    flags = [False] * len(items)
    for i in range(len(items) - w + 1):
        if counts[tuple(items[i : i + w]) if isinstance(items, list) else items[i : i + w]] > 1:
            flags[i : i + w] = [True] * w
    return flags


def brute_words(rows, w=35):
    docs = [(d, [x for x in split(t) if x]) for d, t in rows]
    counts = Counter(tuple(ws[i : i + w]) for _, ws in docs for i in range(len(ws) - w + 1))
    out = []
    for d, ws in docs:
        flags = covered(ws, counts, w)
        kept = " ".join(x for x, f in zip(ws, flags, strict=True) if not f)
        out.append((d, len(ws), sum(flags), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fixture(seed, n=60, alphabet=40, unit=" "):
    """Documents that share passages, with edits, repetitions and copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(alphabet))
    passages = [[word() for _ in range(rng.randrange(20, 130))] for _ in range(6)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rng.randrange(1, 5)):
            body += [word() for _ in range(rng.randrange(0, 60))]
            p = list(rng.choice(passages))
            if rng.random() < 0.5 and p:
                p[rng.randrange(len(p))] = word()
            body += p[: rng.randrange(len(p)) + 1] if rng.random() < 0.3 else p
        rows.append((i, unit.join(body)))
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (0, rows[0][1]), (None, None), (None, ""), (n + 2, " \n"), (n + 3, "x " * 200), (n + 4, "é ü " * 90)]
    return rows


def test_words_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert result(QUERIES["op3_substring"](spark, SF)) == brute_words([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("most", [256, 2])
def test_words_fixture(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    rows = fixture(5)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, k1 int, spans string").repartition(5)
    assert result(substring.report(docs)) == brute_words(rows)


def thue_morse(n, flip):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_words_whose_numbers_collide_stay_apart(spark):
    """Two different words with one polynomial number modulo 2^64: the documents share no window."""
    a, b = thue_morse(1024, 0), thue_morse(1024, 1)
    assert substring.read(a).symbols[0] == substring.read(b).symbols[0] and a != b
    lead = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {b} tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.report(docs)) == brute_words(rows)
    assert [r[2] for r in result(substring.report(docs))] == [0, 35, 35]


@pytest.mark.parametrize("operator", [substring, suffixes])
def test_many_rows_equal_in_id_and_text_and_a_full_bitmap(spark, monkeypatch, operator):
    monkeypatch.setattr(repeats, "FULL", 0)
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, text)] * 1000 + [(i, f"{text[: 5 * i]} v{i} {text}") for i in range(2, 40)] + [(99, "alone " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    brute = brute_words if operator is substring else brute_bytes
    assert result(operator.report(docs)) == brute(rows)


@pytest.mark.parametrize("operator", [substring, suffixes])
def test_near_copies_that_crowd_one_key(spark, monkeypatch, operator):
    """One passage with a different word changed in each of 300 documents: every round of narrowing has work."""
    monkeypatch.setattr(repeats, "MOST", 8)
    rng = random.Random(4)
    base = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(300):
        ws = list(base)
        ws[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    brute = brute_words if operator is substring else brute_bytes
    assert result(operator.report(docs)) == brute(rows)


def test_empty_table(spark):
    assert substring.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffixes.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_bytes(rows, w=200):
    docs = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(b[i : i + w] for _, b in docs for i in range(len(b) - w + 1))
    out = []
    for d, b in docs:
        flags = covered(b, counts, w)
        kept = bytes(x for x, f in zip(b, flags, strict=True) if not f)
        starts = sum(f and not p for f, p in zip(flags, [False, *flags], strict=False))
        out.append((d, len(b), sum(flags), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_bytes_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert result(QUERIES["op2_suffix_array"](spark, SF)) == brute_bytes([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("most", [256, 2])
def test_bytes_fixture(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    rows = fixture(6)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, k1 int, spans string").repartition(5)
    assert result(suffixes.report(docs)) == brute_bytes(rows)


def test_columns_give_the_suffix_array():
    rng = random.Random(3)
    strings = [np.array([rng.randrange(3) for _ in range(rng.randrange(0, 25))], np.int64) for _ in range(40)]
    sid, length, lcp = suffixes.columns(strings)
    every = sorted((tuple(s[len(s) - n :].tolist()), i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
    assert [x[0] for x in every] == [tuple(strings[i][len(strings[i]) - n :].tolist()) for i, n in zip(sid, length, strict=True)]
    for a, b, got in zip(every[:-1], every[1:], lcp[1:].tolist(), strict=True):
        want = next((k for k, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0])))
        assert got == want
