"""The training-data queries that have SQL, against it."""

import duckdb
import pytest

from lodestar.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
