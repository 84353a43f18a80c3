from decimal import Decimal

import duckdb
import pytest

from hashwood.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    expected = db.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    plain = lambda v: int(v) if isinstance(v, Decimal) else v
    rows = [tuple(plain(r[expected.columns.index(c)]) for c in found.columns) for r in expected.fetchall()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
