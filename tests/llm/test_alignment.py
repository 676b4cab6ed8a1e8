"""Alignment by chunks against whole texts, and counts against plain ones."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procera.llm import alignment
from procera.llm.alignment import FOLDER, Document, files_in, pair
from procera.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
A = Tokenizer.from_file(files_in(FOLDER)[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=files_in(FOLDER)[1])
LETTERS = {c: bytes([b]) for c, b in alignment.byte_letters().items()}


def entry_bytes(token):
    return b"".join(LETTERS[c] for c in A.id_to_token(token))


def piece_bytes(token):
    piece = B.id_to_piece(token)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(token) else piece.replace("▁", " ").encode()


def whole(text):
    """Groups of (A ids, B ids) of a text encoded at once."""
    if not text:
        return []
    sides, ends = [], []
    for ids, spell in ((A.encode(" " + text, add_special_tokens=False).ids, entry_bytes), (B.encode(text), piece_bytes)):
        at, held = 0, []
        for x in ids:
            at += len(spell(x))
            held.append((at, x))
        if b"".join(map(spell, ids)) != (" " + text).encode():
            return []
        sides.append(held)
        ends.append({at for at, _ in held})
    groups, low = [], 0
    for high in sorted(ends[0] & ends[1]):
        groups.append(tuple([x for at, x in side if low < at <= high] for side in sides))
        low = high
    return groups


def told(groups):
    text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def linked(groups):
    return Counter(x << alignment.SHIFT | y for a, b in groups for x in a for y in b)


def same(found, groups):
    links = linked(groups)
    assert found.sizes == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()))
    assert found.groups == told(groups) and dict(zip(found.keys.tolist(), found.times.tolist(), strict=True)) == links


parts = st.sampled_from(["a", "word", "Z", "é", "ß", "ж", "א", "字", "1", "22", "²", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", "\xa0", "　", "\x1c", "\x00", ".", ",", "'s", "'", "(", "_", "();\r", "😀", "▁", "<|endoftext|>", "<s>", "<0x0A>", "ing"])


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, max_size=25))
def test_chunks_spell_what_whole_texts_do(found):
    text = "".join(found)
    if text:
        same(next(pair(*files_in(FOLDER)).documents([text])), whole(text))


def test_long_texts_go_in_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 50)
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    texts = ["x", "word, " * 40 + "fin.\n\nnext\tone ", "b" * 300, " " * 200 + "é", "one two", "bad ▁ text", "after"]
    for found, text in zip(pair(*files_in(FOLDER)).documents(texts), texts, strict=True):
        same(found, whole(text))


def plain(texts):
    """Rows of the report, by definition."""
    groups = [whole(t) for t in texts]
    counts = Counter(k for g in groups for k in linked(g))
    best = {}
    for k, n in counts.items():
        best[k >> alignment.SHIFT] = max(best.get(k >> alignment.SHIFT, 0), n)
    out = []
    for g in groups:
        links = linked(g)
        top = sum(n for k, n in links.items() if counts[k] == best[k >> alignment.SHIFT])
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), top, sum(n * counts[k] for k, n in links.items()), told(g)))
    return out, counts


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([r.text for r in docs])
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_alignment"](spark, SF).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)}


@pytest.mark.parametrize("part", [1, 60, 1 << 20])
def test_edges_and_counts(spark, part):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (3, ""), (None, "the dog"), (4, " "), (5, "▁x"), (6, "the " * 300), (7, "Ünï çode 字")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, part int")
    want, counts = plain([t for _, t in rows])
    got = [tuple(r) for r in alignment.report(df, part=part).collect()]
    assert sorted(got, key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    assert {r.a << alignment.SHIFT | r.b: r["count"] for r in alignment.counts(df).collect()} == counts
    assert alignment.report(df.limit(0)).isEmpty() and alignment.report(df.where("text IS NULL")).first().n_links == 0


def test_rows_are_documents_and_parts_are_bounded(spark):
    texts = ["the cat sat", "the dog", None, "the " * 300] * 50 + [None, ""] * 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    held = alignment.parts(df, files_in(FOLDER), 6400)
    rows = held.select("part", "doc_id", "n_links", F.size("at").alias("n_at"), F.size("keys").alias("n_keys")).collect()
    groups = [linked(whole(t)) for t in texts]
    assert sorted((r.doc_id, r.n_links, r.n_at) for r in rows) == [(i, sum(g.values()), len(g)) for i, g in enumerate(groups)]
    for name in {r.part for r in rows}:
        mine = [r for r in rows if r.part == name]
        assert sum(alignment.ROW + len(texts[r.doc_id] or "") for r in mine[:-1]) < 6400
        assert [r.n_keys for r in mine if r.n_keys is not None] == [len(set().union(*(groups[r.doc_id] for r in mine)))]
    assert "collect_list" not in alignment.report(df)._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_is_spelt_by_nothing():
    assert Document().sizes == (0, 0, 0, 0) and Document().groups == ""
