"""Every registered query of the library against its SQL on the smallest tables; the rest must run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from keelson.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.SQL[name]}) AS q").fetchall()
    assert plain(map(tuple, got.collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.COVERS) == set(catalog.QUERIES)
