import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_queries_and_sql_have_the_same_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_core_queries_give_a_schema(spark):
    from actloom.plans import catalog

    for name in ("p1_sections", "url_normalize", "status_counts", "stream_status", "rrf_fuse"):
        assert catalog.QUERIES[name](spark, SMALL).count() >= 0
