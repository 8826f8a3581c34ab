import pytest
from oracle import compare

from pixelloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], DATA)
