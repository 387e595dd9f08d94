"""Each genotype query against DuckDB on the smallest tables."""

import comparison
import pytest

from allelix import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return comparison.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert comparison.rows_of_spark(queries.QUERIES[name](spark, SF)) == comparison.rows_of_sql(con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
