"""The training-data queries that SQL can say, against DuckDB on the same tables."""

import duckdb
import pytest

from palimpsest.llm import queries

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(name, spark, middle):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{middle}/{t}.parquet'")
    got = queries.QUERIES[name](spark, middle)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    clean = lambda x: round(x, 12) if isinstance(x, float) else x
    mine = sorted((tuple(clean(r[c]) for c in names) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(map(clean, r)) for r in want.fetchall()), key=repr)
