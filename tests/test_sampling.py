from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tripletspark.operators import indexing as ix
from tripletspark.operators import sampling as sp


def expected_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_dense_index(spark, n):
    for parts in (1, 7):
        got = {r.id: r.idx for r in ix.dense_index(spark.range(n).repartition(parts), "id")
               .collect()}
        assert got == {i: k for k, i in enumerate(expected_order(range(n)))}


def test_dense_index_per_group(spark):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 5))
    got = ix.dense_index(df, "id", group_cols=["g"]).collect()
    by_group: dict = {}
    for r in got:
        by_group.setdefault(r.g, []).append(r)
    for rows in by_group.values():
        order = expected_order([r.id for r in rows])
        assert {r.id: r.idx for r in rows} == {i: k for k, i in enumerate(order)}


@pytest.mark.parametrize("n, fraction, total, want", [
    (30, None, 100, 30), (0, None, 100, 0), (500, None, 100, 100), (5, None, 0, 0),
    (None, 0.1, 25, 3), (None, 0.1, 1, 1), (None, 0.5, 2, 1), (40_000, None, 50_000, 40_000)])
def test_mark_sample_is_exact(spark, n, fraction, total, want):
    df = spark.range(total)
    got = sorted(r.id for r in ix.mark_sample(df, "id", n=n, fraction=fraction)
                 .filter("in_sample").collect())
    assert got == sorted(expected_order(range(total))[:want])


def test_split_is_a_partition(spark):
    for parts in (1, 4, 32):
        train, val = sp.train_val_split(spark.range(25).repartition(parts), "id", 0.1)
        a, b = {r.id for r in train.collect()}, {r.id for r in val.collect()}
        assert len(a) == 22 and len(b) == 3 and a | b == set(range(25))


def test_sample_n_small_and_large_agree(spark, monkeypatch):
    df = spark.range(200)
    small = {r.id for r in sp.sample_n(df, 20, "id").collect()}
    monkeypatch.setattr(sp, "TOP_N_ON_DRIVER", 5)
    assert {r.id for r in sp.sample_n(df, 20, "id").collect()} == small and len(small) == 20


@pytest.mark.parametrize("n, k", [(0, 2), (1, 2), (2, 2), (3, 5), (100, 5), (100, 200)])
def test_random_partners(spark, n, k):
    got = sp.random_partners(spark.range(n), "id", k).collect()
    lists: dict = {}
    for r in got:
        lists.setdefault(r.id, []).append(r.neg_id)
    assert len(lists) == (n if n > 1 else 0)
    for i, found in lists.items():
        assert len(found) == min(k, n - 1) == len(set(found)) and i not in found


def test_random_partners_spread(spark):
    counts = (sp.random_partners(spark.range(1000), "id", 5).groupBy("neg_id").count()
              .agg(F.max("count").alias("m")).first().m)
    assert counts < 40


def test_random_negatives_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    rows = {r.id: r.negatives for r in sp.random_negatives(df, "id", "t", 5).collect()}
    assert {k: sorted(v) for k, v in rows.items()} == {1: ["b", "c"], 2: ["a", "c"], 3: ["a", "b"]}
    alone = sp.random_negatives(df.limit(1), "id", "t", 5).collect()
    assert [r.negatives for r in alone] == [[]]


@pytest.mark.parametrize("chunks", [None, 1, 7, 50])
def test_assign_batches(spark, chunks):
    df = spark.range(103).select((F.col("id") * 3 - 50).alias("k"))
    got = {r.k: r.batch for r in ix.assign_batches(df, 10, "k", chunks).collect()}
    assert got == {3 * i - 50: i // 10 for i in range(103)}
    assert max(got.values()) + 1 == math.ceil(103 / 10)


@pytest.mark.parametrize("chunks", [None, 1, 9])
def test_rank_of_any_key(spark, chunks):
    """Texts, bytes and dates; nulls first; the same ranks from any partitioning."""
    rows = [(i, None if i % 5 == 0 else ["é", "a", "B", "", "zz"][i % 4] + str(i % 7),
             bytes([i % 3, i % 11])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, b binary").withColumn(
        "d", F.date_add(F.lit("2024-01-01"), (F.col("id") % 9).cast("int")))
    for col, key in (("t", lambda r: (r[1] is not None, (r[1] or "").encode(), r[0])),
                     ("b", lambda r: (r[2], r[0])), ("d", lambda r: (r[0] % 9, r[0]))):
        want = {r[0]: k for k, r in enumerate(sorted(rows, key=key))}
        for parts in (1, 6):
            got = ix.global_rank(df.repartition(parts), [col, "id"], chunks)
            assert {r.id: r["rank"] for r in got.collect()} == want
    assert ix.global_rank(df.limit(0), ["t"], chunks).count() == 0


def test_one_value_in_a_third_of_all_rows_is_cut(spark):
    """By the tie column, for a value and for null."""
    for hot in ("x", None):
        df = spark.range(9000).select("id", F.when(F.col("id") < 3000, F.lit(hot)).otherwise(
            F.col("id").cast("string")).alias("t"))
        cut = df.repartitionByRange(12, F.col("t").asc_nulls_first(), F.col("id"))
        sizes = cut.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 1500 and len(sizes) == 12
        got = ix.assign_batches(df, 100, "t", 12, tie_cols=["id"])
        assert got.groupBy("batch").count().filter("count <> 100").count() == 0
        if hot is None:
            assert {r.batch for r in got.filter("t IS NULL").collect()} == set(range(30))


def test_ordered_index_with_hot_value(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, 5).otherwise(F.col("id"))
                                 .alias("k"))
    chunked = ix.order_chunks(df, "k", 8)
    got = {r.id: r.step_no for r in ix.ordered_index(chunked, "k", ["id"]).collect()}
    assert got == {i: i for i in range(300)}


def test_running_total(spark):
    df = spark.range(50).select(F.col("id").alias("g"), (F.col("id") + 1).alias("v"))
    rows = ix.running_total(df, ["g"], "v", "before", total="all").collect()
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r.g).encode()).hexdigest(), r.g))
    total = 0
    for r in order:
        assert r.before == total and r["all"] == 1275
        total += r.v
