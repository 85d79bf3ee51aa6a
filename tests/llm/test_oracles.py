"""The operators' queries with SQL, against DuckDB."""

import duckdb
import pytest

from terrastrata.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
