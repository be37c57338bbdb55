"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from textloom import register
from textloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(register.ORACLE_SQL))
def test_query_equals_sql(spark, con, tmp_path, name):
    out = str(tmp_path / "out")
    register.QUERIES[name](spark, SF).write.parquet(out)
    con.execute(f"CREATE OR REPLACE TABLE o AS {register.ORACLE_SQL[name]}")
    columns = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE o").fetchall()))
    mine = f"SELECT {columns} FROM '{out}/*.parquet'"
    assert con.execute(f"SELECT {columns} FROM o EXCEPT ALL {mine}").fetchall() == []
    assert con.execute(f"{mine} EXCEPT ALL SELECT {columns} FROM o").fetchall() == []


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(register.ORACLE_SQL) <= set(__spark_entry__.queries())
    assert os.path.exists(SF)


def test_bootstrap_interval_holds_the_mean(spark):
    rows = register.QUERIES["bootstrap_ci"](spark, SF).collect()
    assert rows and all(r["lo"] <= r["mean"] <= r["hi"] for r in rows)
