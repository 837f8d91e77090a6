import pytest

from compare import DATA, differences
from riverbend import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], DATA / "sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0
