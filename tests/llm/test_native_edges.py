"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for the native operators."""

import hashlib
import random
import re

from procera.llm import decontamination, mixing, quality, secrets
from procera.llm.trigrams import trigram_query

WORDS = " ".join(f"word{i} of" for i in range(60))


def test_quality(spark):
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, " \n\t", "en", None), (3, WORDS, "en", "a"), (3, WORDS, "en", "a"), (4, "a b c " * 40, None, "a"), (5, WORDS + " # $ |" * 40, "en", "a"), (6, "x " * 100_000, "en", "a")]
    rows += [(100 + i, f"{WORDS} tail{i}", "en", "a") for i in range(40)]
    docs = spark.createDataFrame([(*r, "q", 1, "m") for r in rows], "doc_id long, text string, lang string, source string, _q string, bucket int, metric string")
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert quality.assess(docs).count() == len(rows)
    assert (got[None].n_words, got[None].base_failed, got[None].kept) == (0, True, False)
    assert (got[4].n_words, got[4].n_repeat_words, got[4].base_failed) == (120, 120, True)
    assert (got[6].n_words, got[6].n_repeat_words) == (100_000, 100_000)
    assert got[3].kept and not got[5].kept and not got[5].base_failed
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 2 and kept.where("doc_id = 5").isEmpty()
    assert quality.assess(docs.limit(0)).count() == 0 and quality.keep(docs.limit(0)).count() == 0


def test_junk_in_under_half_of_a_source_is_rejected(spark):
    rows = [(i, f"{WORDS} {i}" + (" ### $$$" * 30 if i < 45 else ""), "en", "a") for i in range(100)]
    got = quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(45, 100))


def plain_spans(text):
    text = text or ""
    found = []
    for i, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.regex, text, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), i, m.end()))
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(4)
    bits = ["password", "PassWd", "token", "api_key", "ApiKey", "=", ": ", '"', "'", " ", "\n", "é😀", "abc123", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "ghp_", "x" * 40, "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.", "secret"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    rows += [(None, None), (None, "token=abcdef1"), (7, "password: hunter22"), (7, "password: hunter22"), (8, ""), (9, "token = value12 " * 3000)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, mask string, trigram int")
    got = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in secrets.scan(docs).collect()), key=str)
    assert got == sorted(((d, plain_spans(t)) for d, t in rows), key=str)
    empty = {r.doc_id: r for r in secrets.report(docs).where("doc_id = 8").collect()}[8]
    assert (empty.n_assign, empty.spans, empty.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert secrets.report(docs.limit(0)).count() == 0
    hex_only = tuple(r for r in secrets.RULES if r.kind == "hex")  # no rule asks for a trigram
    got = secrets.scan(docs, hex_only).collect()
    want = [[(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", t or "")] for _, t in rows]
    assert sorted([(s.start, s.end) for s in r.spans] for r in got) == sorted(want) and any(want)


def test_secrets_start_no_python_worker(spark):
    plan = secrets.candidates(spark.sql("SELECT 1L AS doc_id, 'x' AS text"), secrets.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_trigram_queries_hold_for_every_match():
    rng = random.Random(5)
    for regex in [r.regex for r in secrets.RULES] + [r"ab(c|d)+efg?hij", r"(foo|ba[rz]){2}x*quux", r"^hello\s+world$", r"a.c", r"[a-z]{3}bcd"]:
        query = trigram_query(regex)
        alphabet = sorted(set(re.sub(r"\W", "", regex)) | set("abcdefhijkloqruxz =:_-. 0123456789KEYAPRIVTBGN"))
        for _ in range(300):
            seed = "".join(rng.choice(["password", "abcefghij", "foobarquux", "hello  world", "xbcd", "AKIA", "eyJ", "ghp_", *alphabet]) for _ in range(12))
            for m in re.finditer(regex, seed):
                assert any(all(t in m[0].lower() for t in c) for c in query)


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, item), (1, item), (None, "Short item"), (3, None), (4, "  ")], "item_id long, text string")
    words = item.split()
    rows = [(1, f"before {item.upper()} after"), (None, item), (2, " ".join(words[:12])), (3, " ".join(words[:11])), (4, None), (5, ""), (6, "short ITEM"), (7, "a short item here"), (8, item), (8, item), (9, "filler " * 50_000 + item)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, hash string")
    got = sorted(((r.doc_id, r.item_id, r.n_shared) for r in decontamination.contained(docs, items).collect()), key=str)
    want = []
    for d, t in rows:
        for i, x in [(1, item), (1, item), (None, "Short item")]:
            cut = lambda s: {tuple(w[i : i + 5]) for w in [s.lower().split()] for i in range(max(1, len(w) - 4))} if s and s.split() else set()
            a, b = cut(x), cut(t)
            if len(a & b) * 100 >= 80 * len(a):
                want.append((d, i, len(a & b)))
    assert got == sorted(want, key=str)
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 7]
    assert decontamination.contained(docs.limit(0), items).count() == 0
    assert decontamination.contained(docs, items.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}") for i in range(300)] + [(None, "a b", None), (None, "a b", None), (5, None, "s0"), (5, None, "s0"), (6, "one", "tiny"), (7, "", "void")]
    docs = spark.createDataFrame([(*r, 3, "z") for r in rows], "doc_id long, text string, source string, size int, queue string")
    once, again = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert once == again and len(once) == len(rows)
    taken, target, total = {}, {}, sum(r[1] for r in once)
    for _, size, source_size, goal, took, source in once:
        assert took <= 3 * size and (size == 0 or took % size == 0) and goal <= 3 * source_size
        taken[source], target[source] = taken.get(source, 0) + took, goal
    assert abs(sum(target.values()) - total) < 1e-6 and 0 <= total - sum(taken.values()) <= 9
    assert all(abs(taken[s] - target[s]) <= 9 for s in taken)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("text IS NULL")).collect()] == [0, 0]


def test_the_cut_in_rounds_is_the_cut_of_one_sort(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), f"s{i * i % 5}") for i in range(400)] + [(1000, "w " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "TICKS", 4)
    for most in (1, 40):
        monkeypatch.setattr(mixing, "EDGE", most)
        assert sorted(map(tuple, mixing.mix(docs).collect())) == want
    assert sum(r[4] for r in want) <= sum(r[1] for r in want)
    twice = mixing.drawn(docs.union(docs))
    assert twice.count() == twice.select("row.doc_id").distinct().count() and all(r.taken == r.copies * r.size for r in twice.collect())


def test_very_many_matches_in_one_text(spark):
    import time

    n = 40_000
    text = "token=abcdef " * n
    docs = spark.createDataFrame([(1, text), (2, "x " + "token=abcdef " * (2 * secrets.BLOCK) + "secret: short")], "doc_id long, text string")
    secrets.report(docs.where("doc_id = 2")).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    assert time.perf_counter() - began < 15
    assert got[1].n_assign == n and got[1].spans == ",".join(f"assign:{13 * i}:{13 * i + 12}" for i in range(n))
    assert got[2].n_assign == 2 * secrets.BLOCK


def test_rows_that_share_an_id_are_verified_for_their_own_items(spark):
    """Many rows without an id, each with an item of its own: candidates grow with the rows, not with rows times items."""
    item = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    n = 400
    docs = spark.createDataFrame([(None, f"start {item(i)} end of row {i}") for i in range(n)] + [(5, item(0)), (5, f"{item(1)} {item(2)}"), (5, item(0))], "doc_id long, text string")
    items = spark.createDataFrame([(i, item(i), "x", 1) for i in range(n)] + [(0, item(0), "y", 2), (None, item(3), "z", 3)], "item_id long, text string, key string, n_shared int")
    keyed = docs.select(decontamination.row_key("doc_id").alias("key"), "text")
    asked = items.select(decontamination.row_key("item_id").alias("item"), "text")
    assert decontamination.candidates(keyed, asked).count() == n + 1 + 3
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contained(docs, items).collect()), key=str)
    want = [(None, i, 8, 8) for i in range(n)] + [(None, 0, 8, 8), (None, None, 8, 8)] + [(5, 0, 8, 8)] * 4 + [(5, 1, 8, 8), (5, 2, 8, 8)]
    assert got == sorted(want, key=str)
    assert decontamination.clean(docs, items).isEmpty()
