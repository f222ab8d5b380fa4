import pytest

from palimpsest.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), ORACLE_SQL[name], connect(sf)) > 0
