import os

import duckdb
import pytest

from regraph.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(got, want):
    def rows(cols, data):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(round(r[i], 4) if isinstance(r[i], float) else r[i] for i in order) for r in data)

    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4) if not any(isinstance(v, str) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("part", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    same(QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name]))
