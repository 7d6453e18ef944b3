"""Each query against its DuckDB counterpart on sf0.001."""

import os

import duckdb
import pytest

from phonolith import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        return repr(int(v) if float(v).is_integer() else float(v))

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    assert normal(rows, got.columns) == normal(want.fetchall(), want.columns)
