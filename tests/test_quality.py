from __future__ import annotations

import bisect

from pyspark.sql import functions as F

from tripletspark.operators import quality as q
from tripletspark.session import broadcast_if_small


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_require_fields(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, [1], True), (2, "", 1, [1], True), (3, None, 0, [], False),
         (4, "a", 1, None, True)], "id int, t string, n int, l array<int>, b boolean")
    good, bad = q.require_fields(df, ["t", "n", "l", "b"])
    assert ids(good) == [1]
    assert {r.id: r.reason for r in bad.collect()} == {
        2: "missing: t", 3: "missing: t,n,l,b", 4: "missing: l"}
    good, bad = q.require_fields(df, ["absent"])
    assert good.count() == 0 and bad.count() == 4


def test_filter_length_is_inclusive(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "é😀x"), (3, "abcd"), (4, "abcde"), (5, None)],
                               "id int, t string")
    assert ids(q.filter_length(df, "t", 3, 4)) == [2, 3]
    assert ids(q.filter_length(df, "t", 2, 5)) == [1, 2, 3, 4]


def test_drop_blank(spark):
    df = spark.createDataFrame([(1, "x", ["a"]), (2, "  \n", ["a"]), (3, "x", []),
                                (4, None, ["a"]), (5, "x", None)],
                               "id int, t string, l array<string>")
    assert ids(q.drop_blank(df, ["t", "l"])) == [1]


def test_remaining(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(2,), (None,)], "id int")
    assert ids(q.remaining(df, done, "id")) == [1, 3]
    assert ids(q.remaining(df, None, "id")) == [1, 2, 3]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)],
                               "id int, t string")
    assert ids(q.dedup(df, "t", "first", "id")) == [1, 2, 4]
    assert ids(q.dedup(df, "t", "last", "id")) == [2, 3, 5]
    assert ids(q.dedup(df, "t", False, "id")) == [2]


def test_dedup_null_is_not_the_text_null(spark):
    df = spark.createDataFrame([(1, None), (2, "null"), (3, "")], "id int, t string")
    assert ids(q.dedup(df, "t", "first", "id")) == [1, 2, 3]


def test_dedup_hot_text_and_partitions(spark):
    df = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot")
                                 .otherwise(F.col("id").cast("string")).alias("t"))
    for parts in (1, 4, 32):
        assert q.dedup(df.repartition(parts), "t", "first", "id").count() == 601


def test_dedup_without_broadcast(spark, monkeypatch):
    """The way beyond the broadcast bound gives the same rows, also for a hot text."""
    df = spark.range(600).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 50).cast("string")).alias("t"))
    want = {k: ids(q.dedup(df, "t", k, "id")) for k in ("first", "last", False)}
    monkeypatch.setattr(q, "broadcast_if_small", lambda d: d.hint("shuffle_merge"))
    assert {k: ids(q.dedup(df, "t", k, "id")) for k in want} == want
    plan = q.dedup(df, "t", "first", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_small_sides_are_counted_before_a_broadcast(spark):
    small = broadcast_if_small(spark.range(5), 5)
    large = broadcast_if_small(spark.range(6), 5)
    assert "ResolvedHint (strategy=broadcast)" in \
        small._jdf.queryExecution().analyzed().toString()
    assert "Hint" not in large._jdf.queryExecution().analyzed().toString()


def test_merge_collections(spark):
    old = spark.createDataFrame([(5, "a"), (6, "b")], "id int, t string")
    new = spark.createDataFrame([(1, "a", "x"), (2, "c", "x"), (3, "c", "x")],
                                "id int, t string, s string")
    merged = q.merge_collections(old, new, "t", "id")
    assert ids(merged) == [2, 5, 6]
    assert ids(q.merge_collections(None, new, "t", "id")) == [1, 2, 3]
    counts = q.count_removed([old, new], merged).first()
    assert (counts.n_before, counts.n_after, counts.n_removed) == (5, 3, 2)


def test_preprocess(spark):
    df = spark.createDataFrame([(1, "short"), (2, " a  long  enough text "),
                                (3, "a long enough text"), (4, None), (5, " " * 50),
                                (6, "x" * 5001)], "id int, t string")
    out = q.preprocess(df, "t", "id")
    assert [(r.id, r.t) for r in out.collect()] == [(2, "a long enough text")]
    report = q.preprocess_report(df, out).first()
    assert (report.n_initial, report.n_final) == (6, 1)
    assert abs(report.pct_retained - 16.666667) < 1e-9
    empty = df.limit(0)
    assert q.preprocess_report(empty, empty).first().pct_retained is None


def test_dataset_checks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, ""), (4, None)], "id int, t string")
    r = q.dataset_checks(df, "t", ["t"], 1, 1).first()
    assert (r.n_rows, r.missing_t, r.n_too_short, r.n_too_long, r.n_repeated) == (4, 2, 1, 2, 1)


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    """Texts, bytes, nested fields, nulls and clashing names count; a few long rows are too much."""
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame(
        [(i, "x" * 1000, None, [["ab"] * 3], (1, "y" * 500)) for i in range(50)],
        "id int, t string, b binary, l array<array<string>>, s struct<n: int, u: string>")
    assert hinted(broadcast_if_small(df)) and hinted(broadcast_if_small(df, 50))
    assert not hinted(broadcast_if_small(df, 49))
    assert not hinted(broadcast_if_small(df, max_bytes=50_000))
    assert hinted(broadcast_if_small(df, max_bytes=100_000))
    assert not hinted(broadcast_if_small(df.select("s"), max_bytes=20_000))
    assert hinted(broadcast_if_small(df.select("id", F.lit(1).alias("id"))))
    assert hinted(broadcast_if_small(df.limit(0)))


def test_length_sketches_merge_within_the_bound(spark, tmp_path):
    """Loads stored one after the other; ranks against all lengths; null texts, no rows."""
    path = str(tmp_path / "sketches")
    lengths = []
    for load in range(3):
        n = 20_000
        size = F.pmod(F.xxhash64("id", F.lit(load)), F.lit(1000 * (load + 1)))
        df = spark.range(n).select(F.repeat(F.lit("x"), size.cast("int")).alias("t"))
        df = df.union(spark.createDataFrame([(None,)], "t string"))
        q.length_sketches(df, "t").write.mode("append").parquet(path)
        lengths += [len(r.t) for r in df.collect() if r.t is not None]
    lengths.sort()
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    rows = q.length_quantiles(stored, [0.01, 0.1, 0.5, 0.9, 0.99]).collect()
    for r in rows:
        assert r.n == len(lengths)
        low, high = bisect.bisect_left(lengths, r.n_chars), bisect.bisect_right(lengths, r.n_chars)
        slack = q.SKETCH_ERROR * r.n + 1
        assert low - slack <= r.share * r.n <= high + slack
    assert q.length_quantiles(stored.limit(0)).count() == 0
    empty = q.length_sketches(spark.createDataFrame([], "t string"), "t")
    assert q.length_quantiles(empty).count() == 0
