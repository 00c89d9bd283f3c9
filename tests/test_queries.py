"""Every query of the engine against its SQL on the smallest tables; those without SQL give rows."""

import pytest
from oracle import DATA, compare

from recbench import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).limit(1).count() == 1
