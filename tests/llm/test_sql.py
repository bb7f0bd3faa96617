"""Queries that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

from helixloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(r[columns.index(c)] for c in df.columns) for r in result.fetchall())
    assert sorted(map(tuple, df.collect())) == want and want


def test_shared_folder_has_its_file_system(spark):
    from helixloom.llm import shared

    assert shared.shared_dir(spark).startswith("file:///")
