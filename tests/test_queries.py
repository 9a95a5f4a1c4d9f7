import pytest

from rankloom.plans import data_queries, model_queries, service_queries
from tests.compare import HERE, same

CASES = [(m.QUERIES[n], m.SQL[n]) for m in (model_queries, service_queries, data_queries) for n in m.SQL]


@pytest.mark.skipif(not HERE, reason="no test tables")
@pytest.mark.parametrize("query,sql", CASES, ids=[q.__name__ for q, _ in CASES])
def test_against_sql(spark, query, sql):
    same(spark, query, sql)


def test_stored_tables_can_be_dropped(spark):
    from rankloom.sources.shared import drop_stored, stored

    assert stored(spark.range(3)).count() == 3
    assert drop_stored(spark) >= 1 and drop_stored(spark) == 0
