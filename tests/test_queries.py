"""Every registered query that has SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from lodestar import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    found, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert rows([tuple(r[c] for c in columns) for r in found.collect()]) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).columns
