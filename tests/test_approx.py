"""The stored cell index: every row indexed, recall against brute force, exact as the way out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletspark.operators import approx
from tripletspark.operators.similarity import mips_topk

SCHEMA = "id long, embedding array<float>"


def frame(spark, m):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m.astype(np.float32))],
                                 SCHEMA).repartition(5)


def clustered(n: int, clusters: int, dims: int = 16, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dims)) * 3
    return centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims))


def hits(df) -> set:
    return {(r.query_id, r.rank, r.doc_id, r.score) for r in df.collect()}


def measured(spark, df, index, **options) -> float:
    q = df.filter("id % 10 = 0")
    exact = mips_topk(q, df, 10, query_id="id", doc_id="id", exclude_self=True)
    found = approx.approx_topk(q, index, 10, query_id="id", exclude_self=True, **options)
    return approx.recall_at_k(found, exact).first().recall


@pytest.mark.parametrize("m", [clustered(1500, 40), np.random.default_rng(1).normal(size=(800, 24))],
                         ids=["clustered", "no structure"])
def test_recall_is_fitted(spark, tmp_path, m):
    df = frame(spark, m)
    index = approx.build_index(df, str(tmp_path / "ix"))
    assert measured(spark, df, index) >= 0.9
    stored = index.rows(spark)
    assert stored.count() == len(m) == stored.select("id").distinct().count()
    assert (index.probes < len(index.cells.pivots) / 4) == (len(m) == 1500)


@pytest.mark.parametrize("broadcast_rows", [4096, 0])
def test_both_paths_and_the_exact_way_out(spark, tmp_path, broadcast_rows):
    m = clustered(600, 12)
    m[:200] = m[0]  # a third of all rows in one cell, equal to the last digit
    m[599] = 0
    df = frame(spark, m)
    index = approx.build_index(df, str(tmp_path / "ix"), block_rows=50, recall=0.3)
    assert max(index.cells.blocks) >= 4
    q = df.filter("id % 3 = 0")
    exact = hits(mips_topk(q, df, 7, query_id="id", doc_id="id", exclude_self=True))
    got = approx.approx_topk(q, index, 7, query_id="id", exclude_self=True, exact=True,
                             broadcast_rows=broadcast_rows, block_rows=20)
    assert hits(got) == exact
    few = approx.approx_topk(q, index, 7, query_id="id", broadcast_rows=broadcast_rows)
    other = approx.approx_topk(q, index, 7, query_id="id",
                               broadcast_rows=4096 - broadcast_rows, block_rows=20)
    assert hits(few) == hits(other)


def test_only_opened_cells_are_read(spark, tmp_path):
    df = frame(spark, clustered(900, 30))
    index = approx.build_index(df, str(tmp_path / "ix"))
    one = approx.approx_topk(df.filter("id = 3"), index, 5, query_id="id", probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "cell#" in pruned and "IN (" in pruned
    assert "ReadSchema: struct<id:bigint,v:array<float>>" in plan


def test_reopened_and_text_ids(spark, tmp_path):
    df = frame(spark, clustered(200, 5)).withColumn("id", F.concat(F.lit("k"), "id"))
    built = approx.build_index(df, str(tmp_path / "ix"))
    again = approx.open_index(spark, str(tmp_path / "ix"))
    assert again.probes == built.probes and np.allclose(again.cells.pivots, built.cells.pivots)
    got = approx.approx_topk(df, again, 1, query_id="id", exact=True)
    assert all(r.score == 1.0 for r in got.collect()) and got.count() == 200


def test_empty_and_single(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = approx.build_index(none, str(tmp_path / "none"))
    assert approx.approx_topk(none, index, 3, query_id="id").count() == 0
    one = frame(spark, np.ones((1, 4)))
    index = approx.build_index(one, str(tmp_path / "one"))
    assert hits(approx.approx_topk(one, index, 3, query_id="id")) == {(0, 1, 0, 1.0)}
    assert approx.approx_topk(one, index, 3, query_id="id", exclude_self=True).count() == 0
    assert approx.approx_topk(none, index, 3, query_id="id").count() == 0
    with pytest.raises(ValueError):
        approx.approx_topk(one, index, 0)
