import pytest

from cladeflow.llm import queries
from tests.oracle import check, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE[name])
