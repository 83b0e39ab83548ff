"""Every registered query with an oracle equals DuckDB's result on the smallest tables."""

import os

import duckdb
import pytest

from strandloom import catalog

from .helpers import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    assert rows
    if name in catalog.oracle_sql():
        found = duck.sql(catalog.oracle_sql()[name])
        at = [list(found.columns).index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
