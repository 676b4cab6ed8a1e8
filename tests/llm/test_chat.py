import random
from collections import defaultdict
from itertools import product

import pytest

from procera.llm import chat
from procera.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def cheapest(given):
    """Least cost by trying every role for every turn and every way to join or pad."""
    best = None
    for roles in product(chat.ROLES, repeat=len(given)):
        cost = sum(1 if g not in chat.ROLES else 2 * (g != r) for g, r in zip(given, roles, strict=True))
        blocks = []
        for i, r in enumerate(roles):
            if i and r == roles[i - 1]:
                cost += chat.MERGE
            else:
                blocks.append(r)
        out, ok = [], True
        for i, r in enumerate(blocks):
            if r == "system":
                ok &= i == 0
            elif r == "assistant" and (not out or out[-1] == "system"):
                out.append("user")
                cost += chat.INSERT
            out.append(r)
        if out[-1] == "system":
            out += ["user", "assistant"]
            cost += 2 * chat.INSERT
        elif out[-1] == "user":
            out.append("assistant")
            cost += chat.INSERT
        if ok and legal(out) and (best is None or cost < best):
            best = cost
    return best


def blocks_of(text):
    out = []
    for part in text.split(chat.CLOSE)[:-1]:
        head, _, body = part.partition("|>\n")
        out.append((head.removeprefix("<|"), body.removesuffix("\n")))
    return out


@pytest.mark.parametrize("piece", [4096, 2])
def test_cost_equals_brute_force_and_result_is_legal(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(60):
        roles = [rng.choice(["system", "user", "assistant", " User ", None, "tool"]) for _ in range(rng.randrange(1, 7))]
        want[c] = cheapest([(r or "").strip().lower() for r in roles])
        rows += [(c, i, r, f"text {c} {i} <|end|>") for i, r in enumerate(roles)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, part int").repartition(4)
    got = {r.conv_id: r for r in chat.formatted(frame).collect()}
    assert {c: r.cost for c, r in got.items()} == want
    for c, r in got.items():
        made = blocks_of(r.text)
        assert legal([x[0] for x in made])
        texts = [x[3].replace("<|", "<\\|") for x in sorted(rows) if x[0] == c] if all(x[2] for x in rows if x[0] == c) else None
        if texts:
            assert [t for _, body in made if body for t in body.split("\n\n")] == texts


def test_whole_table_and_edges(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = QUERIES["op7_chat_format"](spark, SF).collect()
    assert len(got) == turns.count()
    per = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn)):
        per[r.conv_id].append(r)
    for rows in per.values():
        made = blocks_of("".join(r.rendered for r in rows))
        assert legal([x[0] for x in made])
        if len(rows) <= 7:
            assert sum(r.cost for r in rows) == cheapest([r.role for r in rows])
    edge = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a"), (None, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [(r.n_turns, legal([x[0] for x in blocks_of(r.text)])) for r in chat.formatted(edge).collect()] == [(3, True)]
    assert chat.repaired(edge.limit(0)).count() == 0


def test_turns_equal_but_for_their_text_stand_in_order_of_text(spark):
    rows = [(1, 1, "user", c) for c in "qwertyuiopasdfghjklzxcvbnm"] + [(1, 1, "user", "z" * 70 + c) for c in "cab"] + [(2, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [r for r in chat.repaired(frame).orderBy("place").collect() if r.conv_id == 1]
            assert [r.place for r in got] == list(range(29))
            texts = sorted(t for c, _, _, t in rows if c == 1)
            assert all(t in r.rendered for t, r in zip(texts, got, strict=True))
            whole = next(r.text for r in chat.formatted(frame).collect() if r.conv_id == 1)
            assert "".join(r.rendered for r in got) == whole and whole.endswith("<|end|>\n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
