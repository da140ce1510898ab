"""Every registered query against its SQL twin."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import TABLES, rows_of
from tripletspark.plans.catalog import REGISTRY

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(REGISTRY) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf, db, name):
    df = queries()[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if name in ROWS_ONLY:
        assert len(got) > 0
        return
    res = db.execute(oracle_sql()[name])
    want = pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry(spark).count() > 0
