"""Registered queries of the subpackage: against their SQL twins where there are any."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_queries import TABLES, rows_of
from tripletspark.llm.queries import ORACLE, QUERIES


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    res = db.execute(ORACLE[name])
    want = pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
