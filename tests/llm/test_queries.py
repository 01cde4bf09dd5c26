import pytest

from millrace.llm import queries
from tests.test_parity import compare


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_llm(spark, small, name):
    compare(spark, small, name, queries.queries()[name], queries.oracle_sql().get(name), may_be_empty=name == "p10_found")  # nine labels there
