import pytest

from oracle import compare, duck
from procera.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    compare(QUERIES[name](spark, SF), SF, ORACLES[name])


def test_no_oracle_is_empty():
    assert [name for name, sql in ORACLES.items() if not duck(SF, sql)[1]] == []
