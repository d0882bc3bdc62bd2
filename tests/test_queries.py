"""Every registered query of this part against its DuckDB oracle."""

import glob
import os

import duckdb
import pytest

from tracemill.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con, tmp_path):
    out = f"{tmp_path}/out"
    QUERIES[name](spark, sf).write.parquet(out)
    if name not in ORACLES:
        assert spark.read.parquet(out).count() > 0
        return
    con.sql(f"CREATE OR REPLACE TABLE o AS {ORACLES[name]}")
    names = sorted(c[0] for c in con.sql("DESCRIBE o").fetchall())
    if not glob.glob(f"{out}/*.parquet"):
        assert con.sql("SELECT count(*) FROM o").fetchall()[0][0] == 0
        return
    assert names == sorted(spark.read.parquet(out).columns)
    cols = ", ".join(f'"{c}"' for c in names)
    mine = f"(SELECT {cols} FROM '{out}/*.parquet')"
    assert con.sql(f"SELECT count(*) FROM (FROM {mine} EXCEPT ALL SELECT {cols} FROM o)").fetchall() == [(0,)]
    assert con.sql(f"SELECT count(*) FROM (SELECT {cols} FROM o EXCEPT ALL FROM {mine})").fetchall() == [(0,)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7 and set(e.oracle_sql()) <= set(e.queries())
