import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from actloom.session import local_session

    session = local_session("4", partitions=4, memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return con


def plain(value):
    """A value as both engines give it: whole and decimal numbers as floats rounded, lists as tuples."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    try:
        return round(float(value), 6) + 0.0
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query and its SQL give the same rows, as often, whatever their order."""

    def check(query, sql):
        found = query(spark, SMALL)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(found.columns)
        order = [found.columns.index(c) for c in names]
        got = Counter(tuple(plain(r[i]) for i in order) for r in found.collect())
        expected = Counter(tuple(map(plain, r)) for r in result.fetchall())
        assert not got - expected and not expected - got, (list((got - expected).items())[:2], list((expected - got).items())[:2])

    return check
