"""Draws that reach every row at any size, even pair shares, vectors with bad numbers, windows
that are still open."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_similarity import cloud
from tripletspark.functions.text import parse_path
from tripletspark.operators import pairs, sampling, similarity
from tripletspark.sources import files
from tripletspark.streaming.live import live_monitor, store_windows, stored_windows


@pytest.mark.parametrize("n", [24137, 48271, 48273, 100001])
def test_draws_reach_many_rows(spark, n):
    drawn = spark.range(n).select(sampling.partner(F.col("id"), F.lit(n), F.lit(0), 42).alias("b"))
    counts = drawn.groupBy("b").count().agg(F.count("*"), F.max("count")).first()
    assert counts[0] > 0.6 * n  # 63% by chance
    assert counts[1] < 15
    assert spark.range(n).where(
        sampling.partner(F.col("id"), F.lit(n), F.lit(0), 42) == F.col("id")).isEmpty()


def test_negative_pairs_use_many_rows(spark):
    df = spark.range(48271).select("id", (F.col("id") % 7).alias("g"))
    got = pairs.balanced_negative_pairs(df, ["g"], "id", 5000)
    assert got.count() == 5000 and got.select("id_a").distinct().count() > 4000


@pytest.mark.parametrize("n", [1, 100, 600, 800, 1224, 1225, 5000])
def test_every_group_gets_its_share(spark, n):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, 0).otherwise(
        F.col("id") % 5).alias("g"))
    sizes = [r["count"] for r in df.groupBy("g").count().collect()]
    total = sum(m * (m - 1) // 2 for m in sizes)
    got = pairs.positive_pairs(df, ["g"], "id", n)
    rows = got.collect()
    assert len(rows) == min(n, total) == len({(r.id_a, r.id_b) for r in rows})
    assert {r.pair_no for r in rows} == set(range(len(rows)))
    share = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    for r in df.groupBy("g").count().collect():
        due = len(rows) * (r["count"] * (r["count"] - 1) / 2) / total
        assert abs(share.get(r.g, 0) - due) <= 1


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_one_bad_number_spoils_no_other_row(spark, bad):
    df, m = cloud(spark, 120)
    width = m.shape[1]
    dirty = df.union(spark.createDataFrame([(999, [bad] + [0.5] * (width - 1))], df.schema))
    clean = df.union(spark.createDataFrame([(999, [0.0] + [0.5] * (width - 1))], df.schema))
    rows = lambda x: sorted(map(tuple, x.collect()))
    for options in ({}, {"broadcast_rows": 10, "block_rows": 16}):
        ask = lambda d: similarity.mips_topk(d, d, 3, query_id="id", doc_id="id",
                                             exclude_self=True, **options)
        got = rows(ask(dirty))
        assert got == rows(ask(clean)) and len(got) == 3 * 121
    near = lambda d: rows(similarity.similarity_range_counts(d, 0.2, 0.6, block_rows=16))
    assert np.allclose([[v or 0 for v in r] for r in near(dirty)],
                       [[v or 0 for v in r] for r in near(clean)])
    assert rows(similarity.self_similarity_histogram(dirty)) == rows(
        similarity.self_similarity_histogram(clean))


def test_paths_with_and_without_scheme(spark):
    want = ("alice", "cpoolday05", "site")
    for path in ("/r/p0-p1-p2-site-cpoolday05-alice-x/a.c",
                 "file:/r/p0-p1-p2-site-cpoolday05-alice-x/a.c",
                 "hdfs://n:1/r/p0-p1-p2-site-cpoolday05-alice-x/a.c"):
        for root in ("/r", "/r/", "file:///r", "hdfs://n:1/r"):
            row = spark.createDataFrame([(path,)], "c string").select(parse_path("c", root).alias("p"))
            assert tuple(row.first().p) == want


def test_lines_of_other_white_space_are_blank(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\t\n   \n{"a": 2}\n')
    good, rejected = files.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", "skip_bad")
    assert sorted(r.a for r in good.collect()) == [1, 2] and rejected.isEmpty()
    good, _ = files.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", "skip_blank")
    assert good.count() == 2


def test_open_windows_are_stored(spark, tmp_path):
    source = str(tmp_path / "in")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def arrive(rows: list[tuple]) -> None:
        spark.createDataFrame(rows, "ts string, value double").select(
            F.to_timestamp("ts").alias("ts"), "value").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, value double").parquet(source)
        store_windows(live_monitor(stream, "ts", "value", width="1 day", lateness="1 hour"),
                      out, progress)
    arrive([("2024-01-01 10:00:00", 1.0), ("2024-01-02 10:00:00", 2.0)])
    arrive([("2024-01-02 11:00:00", 4.0)])
    got = {str(r.start)[:10]: (r.n, r["mean"]) for r in stored_windows(spark, out).collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-02": (2, 3.0)}
