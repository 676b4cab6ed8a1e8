from collections import Counter, defaultdict

import pytest

from procera.llm import templates
from procera.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\v\f\r"


def words(line):
    out = [x for x in "".join(" " if c in BLANKS else c for c in line).split(" ") if x]
    return ["<*>" if any(c in "0123456789" for c in x) else x for x in out]


def hashed(texts):
    """Texts whose lines with sketches of their own make the wanted share: sketches as the operator hashes them, counted plainly."""
    made = {t: templates.Lines(t) for t in texts}
    seen = {t: [(n, pair) for n, pair in zip(lines.words.tolist(), lines.sketches.tolist(), strict=True)] for t, lines in made.items()}
    counts = Counter(x for lines in seen.values() for x in {y for _, pair in lines for y in pair})
    out = set()
    for t, lines in seen.items():
        taken, own = set(), 0
        for n, pair in lines:
            own += n * (all(counts[x] == 1 and x not in taken for x in pair) and len(set(pair)) == len(pair))
            taken |= set(pair)
        if own * 100 >= templates.OWN * sum(n for n, _ in lines) and own:
            out.add(t)
    return out


def plain(texts):
    """The same by definition: an own line shares no run of five words (or whole shorter line) with another text."""
    runs = {}
    for t in texts:
        runs[t] = []
        for line in (t or "").split("\n"):
            w = [x for x in "".join(" " if c in BLANKS else c for c in line).split(" ") if x]
            if w:
                runs[t].append((len(w), {tuple(w[i : i + templates.SHINGLE]) for i in range(max(1, len(w) - templates.SHINGLE + 1))}))
    counts = Counter(x for lines in runs.values() for x in set().union(*(r for _, r in lines)))
    return {t for t, lines in runs.items() if lines and sum(n for n, r in lines if all(counts[x] == 1 for x in r)) * 100 >= templates.OWN * sum(n for n, _ in lines)}


def brute(rows, least=templates.CONTEXTS, telling=hashed):
    """The same tree, grown over all lines at once with plain dictionaries."""
    occurrences = defaultdict(set)
    for text in {t for _, t in rows}:
        for x in {tuple(words(x)) for x in (text or "").split("\n")} - {()}:
            occurrences[x].add(text)
    copies = Counter(t for _, t in rows)
    told = telling(set(copies))
    leaves, rows_at = defaultdict(list), defaultdict(set)
    for x, texts in occurrences.items():
        leaf = (len(x), x[: templates.DEPTH])
        leaves[leaf].append(x)
        rows_at[leaf] |= texts
    held = Counter()
    for x, texts in occurrences.items():
        held[x] = len({(repr(d), t) for d, t in rows if t in texts})
    bad = set()
    for leaf, lines in leaves.items():
        if sum(copies[t] for t in rows_at[leaf]) < least:
            continue
        groups = []
        for x in sorted(lines, key=lambda x: (-held[x], " ".join(x).encode())):
            scores = [sum(a == b for a, b in zip(t, x, strict=True)) for t, _ in groups]
            if scores and max(scores) >= templates.SIMILAR * len(x):
                t, members = groups[scores.index(max(scores))]
                t[:] = [a if a == b else None for a, b in zip(t, x, strict=True)]
                members.append(x)
            else:
                groups.append((list(x), [x]))
        for _, members in groups:
            texts = set().union(*(occurrences[x] for x in members))
            good = len(texts & told)
            if good >= least and good * templates.SPREAD >= len(texts):
                bad |= set(members)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if tuple(words(x)) not in bad]
        out.append((d, "\n".join(kept) if len(kept) < len(lines) else text, len(lines) if text else 0, len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = result(QUERIES["op10_line_templates"](spark, SF))
    assert sum(r[3] for r in got) > 100
    assert got == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("most", [1000, 2])
def test_variables_copies_and_edges(spark, monkeypatch, most):
    monkeypatch.setattr(templates, "MOST", most)
    rows = [(i, f"start of document number{i} is here\nPage {i} of 300 printed\nbody {chr(97 + i % 26) * (i + 1)} text\n\nend {i}x") for i in range(20)]
    rows += [(100 + i, "one copy\nof the same text\nthrice told") for i in range(40)] + [(None, None), (7, ""), (8, "\n\n"), (None, "Page 4 of 300 printed")]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n_lines int, gone string").repartition(4)
    got = result(templates.report(docs))
    assert got == brute(rows) == brute(rows, telling=plain)
    kept = templates.cleaned(docs)
    assert kept.columns == docs.columns and {(r.n_lines, r.gone) for r in kept.collect()} == {(5, "x")}
    by_id = {r[0]: r for r in got}
    assert by_id[3][1].startswith("body")
    assert by_id[120][1] == "one copy\nof the same text\nthrice told"


def test_empty_table(spark):
    assert templates.cleaned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_group_of_copies_does_not_protect_a_line(spark):
    own = lambda i: "\n".join(f"own {chr(97 + i)} part {chr(97 + k)} {chr(97 + i) * (k + 5)}" for k in range(6))
    rows = [(i, f"All rights stay with us\n{own(i)}") for i in range(15)]
    rows += [(100 + i, f"All rights stay with us\n{own(20)}") for i in range(2000)]
    got = {r[0]: r[1] for r in result(templates.cleaned(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(got[i] == own(i) for i in range(15))
    assert all(got[100 + i] == own(20) for i in range(2000))


@pytest.mark.parametrize("most", [1000, 8])
def test_a_template_of_many_names_in_a_crowded_leaf(spark, monkeypatch, most):
    monkeypatch.setattr(templates, "MOST", most)
    count = 1500 if most == 1000 else 60
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    own = lambda i: f"Own {name(i)} text {name(i * 7 + 3)} of page {name(i * 11 + 5)}\nClosing {name(i)} words {name(i + 9)}"
    rows = [(i, f"Read more about {name(i)} in our archive today\n{own(i)}") for i in range(count)]
    rows += [(count + i, f"Read more about {name(i)} {name(i * 3 + 1)} {name(i * 5 + 2)} {name(i * 7)} {name(i * 9 + 4)}") for i in range(count)]
    got = {r[0]: r[1] for r in result(templates.cleaned(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(got[i] == own(i) for i in range(count))
    assert all(got[count + i] == rows[count + i][1] for i in range(count))


@pytest.mark.parametrize("lines", [2, 8])
def test_a_licence_longer_than_the_documents_goes(spark, lines):
    """Long lines that always stand together, under short bodies of their own."""
    licence = "\n".join(" ".join(f"{chr(97 + k)}law{chr(97 + j)}" for j in range(26)) for k in range(lines))
    own = lambda i: f"short {chr(97 + i % 26)}{chr(97 + i // 26)} body of {chr(97 + i // 26)}{chr(97 + i % 26)} in"
    rows = [(i, f"{licence}\n{own(i)}\n{own(i)[::-1]}") for i in range(100)]
    got = result(templates.report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows, telling=plain)
    assert {r[0]: r[1] for r in got} == {i: f"{own(i)}\n{own(i)[::-1]}" for i in range(100)}


def test_edited_copies_keep_their_lines(spark):
    import random

    rng = random.Random(9)
    base = [[f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(40)] for _ in range(8)]
    rows = []
    for i in range(300):
        lines = [list(x) for x in base]
        for _ in range(9):
            lines[rng.randrange(8)].insert(rng.randrange(40), "new" + "".join(chr(97 + rng.randrange(26)) for _ in range(3)))
        rows.append((i, "\n".join(map(" ".join, lines))))
    got = {r[0]: r[1] for r in result(templates.cleaned(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert sum(got[d] == t for d, t in rows) == len(rows)
