"""Every query of the catalog against its SQL twin, over the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from sparquill import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple("NULL" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = db.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
