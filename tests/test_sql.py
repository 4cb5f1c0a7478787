import pytest

from actloom.plans import catalog

#: Compared on fixtures of their own, as they take long even on small tables.
ELSEWHERE = {"p3_hierarchy", "p3_descendants"}


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - ELSEWHERE))
def test_query_and_sql_agree(same_rows, name):
    same_rows(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
