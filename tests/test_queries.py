"""Each registered tree query against its oracle, on small tables."""

import duckdb
import pandas as pd
import pytest

from hashwood.plans import catalogue

SF = "/root/testdata/sf0.01"
SLOW = {"grove_online", "grove_bidirectional", "grove_anti_entropy", "grove_counter", "grove_set_union"}  # minutes of messages each; test_replicas.py has their scenarios


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def normal(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(None if x is None or x != x else x.tolist() if hasattr(x, "tolist") else x for x in row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [q for q in catalogue.queries() if q not in SLOW])
def test_equals_oracle(spark, oracle, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    expected = oracle.sql(catalogue.oracle_sql()[name]).to_df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected) and len(got)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
