"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from vertexflow.plans import catalog, surface

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def close(x, y):
    return x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


QUERIES, ORACLES = catalog.QUERIES | surface.QUERIES, catalog.ORACLES | surface.ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    relation = db.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    expected = sorted(relation.select(*(f'"{c}"' for c in columns)).fetchall(), key=repr)
    assert len(found) == len(expected)
    assert all(close(x, y) for a, b in zip(found, expected) for x, y in zip(a, b))


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["id", "level"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
