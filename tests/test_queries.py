import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    out = duck.execute(registry.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() == 3185


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
