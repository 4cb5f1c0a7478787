import pytest

from actloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_and_sql_agree(same_rows, name):
    same_rows(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
