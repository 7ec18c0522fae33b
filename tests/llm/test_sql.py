"""Queries that SQL can express, against DuckDB."""
import duckdb
import pytest

from framelake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", ORACLES)
def test_against_duckdb(spark, sf, key):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel, df = con.sql(ORACLES[key]), QUERIES[key](spark, sf)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(str, df.select(cols).toLocalIterator())) == sorted(str(__import__("pyspark").sql.Row(**dict(zip(cols, r)))) for r in rel.select(*cols).fetchall())
