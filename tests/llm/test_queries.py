import pytest

from rankloom.llm.queries import QUERIES, SQL
from tests.compare import HERE, same


@pytest.mark.skipif(not HERE, reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])
