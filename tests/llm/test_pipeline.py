import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from test_templates import brute

from procera.llm import decontamination, mixing, quality, simhash
from procera.llm.common import written

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = [x for x in (text or "").lower().split() if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_sql(sql, documents):
    db = duckdb.connect()
    db.register("documents", documents)
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return db.sql(sql).fetchall()


def test_every_stage_equals_its_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = written(stages[name](spark, docs, SF), f"test-{name}")
        return out, docs.toPandas()

    kept, before = step("quality_rules", docs)
    good = {r[0] for r in by_sql(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept", pa.Table.from_pandas(before))}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == columns

    lined, before = step("line_dedup", kept)
    want = {r[0]: r[1] for r in brute(list(zip(before.doc_id, before.text, strict=True)))}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == columns

    single, before = step("near_dedup", lined)
    sets = {d: shingles(t) for d, t in zip(before.doc_id, before.text, strict=True)}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    similar = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    pairs = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    strong = [(a, b) for a, b in pairs if similar(a, b) >= 0.8]
    for a, b in strong:
        parent[find(a)] = find(b)
    groups = {r.doc_id: r.component_id for r in simhash.similar(lined).collect()}
    assert len(strong) > 30
    assert sum(groups[a] == groups[b] for a, b in strong) >= 0.97 * len(strong)
    cosine = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a]) * len(sets[b])) ** 0.5
    alike = [(a, b) for a, b in pairs if cosine(a, b) >= 0.8]
    assert sum(groups[a] == groups[b] for a, b in alike) >= 0.95 * len(alike)
    loose = defaultdict(set)
    for a, b in pairs:
        if cosine(a, b) >= 0.7:
            loose[a].add(b)
            loose[b].add(a)
    assert all(loose[d] for d, c in groups.items() if c != d and sets[d])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    clean, before = step("decontaminate", single)
    bad = {r[0] for r in by_sql(decontamination.ORACLE, pa.Table.from_pandas(before))}
    assert bad and {r.doc_id for r in clean.collect()} == set(before.doc_id) - bad and clean.columns == columns

    mixed, before = step("mix_sources", clean)
    want = {tuple(r) for r in by_sql(mixing.ORACLE, pa.Table.from_pandas(before)) if r[4] > 0}
    got = {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixed.collect()}
    assert {(a, b, c, e) for a, b, c, _, e in got} == {(a, b, c, e) for a, b, c, _, e in want}
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert all(r.text == texts[r.doc_id] and r.taken == r.copies * r.size for r in mixed.collect())


def test_run_is_the_stages_one_after_the_other(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 < r.taken <= 3 * r.size and r.text and r.copies for r in rows)


def test_columns_that_clash_with_the_stages_own_stay(spark, tmp_path):
    text = lambda i: " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))
    rows = [(i, f"{text(i)}\nAll rights of this house are reserved", "en", "s", 777, 778, f"k{i}", "row") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long, n_dropped int, k1 string, row string")
    spark.createDataFrame([(1, text(3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "test-clash")
        assert name == "mix_sources" or len(docs.columns) == 8
    got = {r.doc_id: r for r in docs.collect()}
    assert len(got) > 50 and 3 not in got
    assert all((r.text, r.n_lines, r.n_dropped, r.k1, r.row) == (text(d), 777, 778, f"k{d}", "row") for d, r in got.items())


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _q int"
    text = " ".join(f"word{i}" for i in range(80))
    odd = [(None, None, None, None, None, "x", 1), (1, "", None, "s", 0, "x", 1), (2, text, None, None, 9, "x", 1), (2, text, None, None, 9, "x", 1), (3, text, "en", "s", 9, "x", 1), (4, text + " more", "en", "t", 9, None, None)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), "test-odd")
        assert docs.count() == (1 if rows else 0)


def test_rows_without_or_with_repeated_id_stand_for_themselves(spark):
    text = lambda i: " ".join(f"t{i}w{k}" for k in range(60))
    rows = [(None, text(i), 1) for i in range(10)] + [(7, text(20), 1), (7, text(21), 1), (8, text(20), 1), (7, text(20), 1), (None, text(3), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    want = sorted([(None, text(i)) for i in range(10)] + [(7, text(20)), (7, text(21))], key=str)
    for dedup in (simhash.distinct_documents, simhash.deduplicated):
        got = dedup(docs)
        assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    items = spark.createDataFrame([(1, text(3)), (2, text(21))], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontamination.clean(docs, items).collect()), key=str)
    assert got == sorted(((d, t) for d, t, _ in rows if t not in (text(3), text(21))), key=str)
