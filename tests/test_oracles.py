"""Every registered query against its DuckDB statement, over whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_oracle(name, spark, db, sf_dir):
    df = driver.queries()[name](spark, sf_dir)
    got = _sorted_rows(df.columns, df.collect())
    cursor = db.execute(driver.oracle_sql()[name])
    want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_gives_one_row_per_fov(spark):
    rows = {r["fov_deg"]: r for r in driver.entry(spark).collect()}
    assert sorted(rows) == [45, 90, 180, 360]
    assert rows[360]["recall_at_1_q"] == 1_000_000
    assert all(r["out_of_range"] == 0 for r in rows.values())
