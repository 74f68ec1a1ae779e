"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from vitrine.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def rows(columns, data):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return columns, sorted((tuple(map(plain, r)) for r in data), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = rows(columns, df.select(*columns).collect())
    if name in ORACLES:
        b = db.sql(ORACLES[name])
        wanted = sorted(b.columns)
        assert found == rows(wanted, b.project(",".join(f'"{c}"' for c in wanted)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "total_items"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
