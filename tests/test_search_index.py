"""The stored index gives what the scan gives, and reads its own pieces first."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procera.functions.trigrams import required
from procera.operators import filters, search_index
from procera.operators.search_index import SearchIndex
from procera.sources.adapter import registros

SF = "/root/testdata/sf0.001"
TERMS = [
    "0012", "nation_1", "nation.1[0-2]$", "^customer#0000001", "none", "non[ef]", "ab", "(widget|bolt) (sm|ec)+", "a|nation", "red (widget)? ?small",
    r"\d\d", "00.?12", "customer#00000(01|02)+", "x{3}y", "(?:nation)(?=_1)", "none|#0000001", "ring.*economy", "ção", "zzzz", "", "nation_[1-9]{2}", "widget economy", "^none$",
]


@pytest.fixture(scope="module")
def facts(spark):
    extra = [(9_000_001, "José Conceição", None, "77", "NATION_1", "None"), (9_000_002, None, "", "x", "ß nation", None), (9_000_003, "😀😀😀 none", "0012", None, None, "none")]
    named = ["registro_id", "nome", "prontuario", "cpf", "municipio", "cirurgiao"]
    rows = registros(spark, SF).select(*named)
    return rows.unionByName(spark.createDataFrame(extra, ", ".join(f"{c} {'long' if c == 'registro_id' else 'string'}" for c in named))).cache()


@pytest.fixture(scope="module")
def index(facts, tmp_path_factory):
    return SearchIndex(facts.sparkSession, f"{tmp_path_factory.mktemp('index')}/i").build(facts, source="state 1")


def ids(df):
    return sorted(r.registro_id for r in df.select("registro_id").collect())


@pytest.mark.parametrize("term", TERMS)
@pytest.mark.parametrize("literal", [False, True])
def test_same_rows_as_the_scan(facts, index, term, literal):
    for columns in (filters.RECORD_SEARCH, filters.PATIENT_SEARCH, ("cpf", "absent")):
        assert ids(index.search(facts, term, columns, literal)) == ids(filters.search(facts, term, columns, literal))


def test_filtered_frames_and_bad_patterns(facts, index):
    part = facts.where("registro_id % 3 = 0")
    assert ids(index.patient_search(part, "none|#0000001")) == ids(filters.patient_search(part, "none|#0000001"))
    for bad in ("(", "abc("):
        with pytest.raises(filters.SearchPatternError):
            index.search(facts, bad)


def test_plan_reads_postings_and_filters_at_the_scan(spark, index):
    rows = spark.read.parquet(f"{SF}/customer.parquet").withColumnsRenamed({"c_name": "nome"})
    found = SearchIndex(spark, index.table.path + "-c").build(rows, ("nome",))
    plan = found.values("CUSTOMER#000000012", ["nome"], False)._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "In(piece" in plan
    text = found.search(rows, "customer#000000012", ("nome",))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(c_name" in text or "PushedFilters: [IsNotNull(c_name), EqualTo(c_name" in text or "EqualTo(c_name,Customer#000000012)" in text
    assert "RLIKE" not in text


def test_scan_where_the_index_does_not_help(facts, index, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "RLIKE" in plan(index.search(facts, "a.b")) and "RLIKE" not in plan(index.search(facts, "nation_1"))
    assert "RLIKE" in plan(index.search(facts, "nation_1", source="state 2"))  # an index of other rows
    assert "RLIKE" not in plan(index.search(facts, "nation_1", source="state 1"))
    monkeypatch.setattr(search_index, "MOST_VALUES", 3)
    assert "RLIKE" in plan(index.search(facts, "nation_1"))
    assert ids(index.search(facts, "nation_1")) == ids(filters.search(facts, "nation_1"))


def test_rebuilding_replaces(spark, facts, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i").build(facts.limit(0))
    assert index.source() is None and index.search(facts.limit(0), "nation_1").isEmpty()
    index.build(facts, source="s")
    assert index.source() == "s" and ids(index.search(facts, "nation_1")) == ids(filters.search(facts, "nation_1"))


def test_required_pieces():
    as_sets = lambda p: required(p) and [set(x) for x in required(p)]
    assert as_sets("ABCD") == [{"ABC", "BCD"}]
    assert as_sets("ABC|AB") is None and as_sets("ABC|XYZW") == [{"ABC"}, {"XYZ", "YZW"}]
    assert as_sets("^ABC$") == [{"ABC"}] and as_sets("AB.CD") is None and as_sets("(ABC)?") is None
    assert as_sets("(ABC)+D") == [{"ABC"}] and as_sets("X*ABCY?") == [{"ABC"}]
    assert as_sets("ABC(DEF|GHI)") == [{"ABC", "DEF"}, {"ABC", "GHI"}]


atoms = st.sampled_from(["A", "B", "C", "AB", "ABC", "CAB", ".", "[AB]", "^", "$", "A?", "B+", "C*", "(AB|C)", "(ABC|CBA)+", "(?:AB){2}", "\\b", "(?=AB)", "(?:BCA)?"])


@settings(max_examples=300, deadline=None)
@given(st.lists(atoms, min_size=1, max_size=6), st.lists(st.text("ABC ", min_size=0, max_size=14), min_size=1, max_size=6))
def test_matches_hold_required_pieces(parts, texts):
    pattern = "".join(parts)
    needs = required(pattern)
    for text in texts:
        if needs is not None and re.search(pattern, text):
            assert any(all(p in text for p in x) for x in needs)
