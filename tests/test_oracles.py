"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from switchback.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return str(value) if isinstance(value, (list, tuple, dict)) else value


def rows_of(frame, columns):
    frame = frame[columns].astype(object).where(lambda d: d.notna(), None)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(frame.columns)
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows_of(frame, sorted(frame.columns)) == rows_of(want, sorted(frame.columns))


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
