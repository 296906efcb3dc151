import pytest

from bookflow.llm.queries import QUERIES, SQL
from tests.oracle import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(connect(sf), SQL[name])
