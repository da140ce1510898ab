from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletspark.functions import vectors as vx
from tripletspark.operators import similarity as sim

INF, NAN = float("inf"), float("nan")


def cloud(spark, n, d=8, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    if clusters:
        centres = rng.normal(size=(clusters, d)) * 4
        m = centres[rng.integers(0, clusters, n)] + 0.3 * m
    if n > 3:
        m[1] = m[0]      # a tie
        m[2] = 0.0       # a failed embedding
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, embedding array<float>"), \
        np.asarray([np.float32(v) for _, v in rows], dtype=np.float64).reshape(n, d)


def unit(m):
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def brute_topk(q, c, k, exclude_self):
    s = np.round(unit(q) @ unit(c).T, 6)
    out = set()
    for i in range(len(q)):
        order = sorted((j for j in range(len(c)) if not (exclude_self and i == j)),
                       key=lambda j: (-s[i, j], j))[:k]
        out |= {(i, r + 1, j) for r, j in enumerate(order)}
    return out


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vector_functions(spark):
    assert math.isclose(value(spark, vx.cosine_similarity(vec(1, 0), vec(1, 1))), 0.5 ** 0.5)
    assert value(spark, vx.cosine_similarity(vec(0, 0), vec(1, 1))) == 0.0
    assert value(spark, vx.cosine_distance(vec(0, 0), vec(1, 1))) == 1.0
    assert value(spark, vx.euclidean_distance(vec(0, 3), vec(4, 0))) == 5.0
    assert value(spark, vx.manhattan_distance(vec(0, 3), vec(4, 0))) == 7.0
    assert value(spark, vx.l2_normalize(vec(0, 0))) == [0.0, 0.0]
    assert value(spark, vx.l2_normalize(vec(3, 4))) == [0.6, 0.8]
    assert value(spark, vx.sanitize_vectors(vec(NAN, INF, -INF, 1))) == [0.0, 0.0, 0.0, 1.0]
    assert value(spark, vx.has_bad_numbers(vec(1, INF)))
    with pytest.raises(ValueError):
        vx.distance("hamming", "a", "b")


@pytest.mark.parametrize("n, k, clusters", [(0, 3, 0), (1, 3, 0), (2, 3, 0), (60, 5, 0),
                                            (200, 4, 6)])
@pytest.mark.parametrize("exclude", [True, False])
def test_topk_both_shapes(spark, n, k, clusters, exclude):
    df, m = cloud(spark, n, clusters=clusters)
    want = brute_topk(m, m, k, exclude)
    for options in ({}, {"broadcast_rows": 0, "block_rows": 16}):
        got = sim.mips_topk(df, df, k, query_id="id", doc_id="id", exclude_self=exclude, **options)
        assert {(r.query_id, r["rank"], r.doc_id) for r in got.collect()} == want


def test_topk_string_ids_and_two_tables(spark):
    q, mq = cloud(spark, 30, seed=1)
    c, mc = cloud(spark, 90, seed=2)
    want = {(f"q{i:03d}", r, f"d{j:03d}") for i, r, j in brute_topk(mq, mc, 3, False)}
    q = q.select(F.format_string("q%03d", "id").alias("query_id"), "embedding")
    c = c.select(F.format_string("d%03d", "id").alias("doc_id"), "embedding")
    for options in ({}, {"broadcast_rows": 0, "block_rows": 10}):
        got = sim.mips_topk(q, c, 3, **options).collect()
        assert {(r.query_id, r["rank"], r.doc_id) for r in got} == want


def test_topk_with_many_equal_vectors(spark):
    """A third of the corpus is one vector: ties go to the smallest ids, nothing is lost."""
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [math.cos(i), math.sin(i)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    m = np.asarray([np.float32(v) for _, v in rows], dtype=np.float64)
    want = brute_topk(m, m, 6, True)
    for options in ({}, {"broadcast_rows": 0, "block_rows": 10}):
        got = sim.mips_topk(df, df, 6, query_id="id", doc_id="id", exclude_self=True, **options)
        assert {(r.query_id, r["rank"], r.doc_id) for r in got.collect()} == want


@pytest.mark.parametrize("exclude", [True, False])
def test_sets_give_the_whole_result(spark, monkeypatch, exclude):
    """Many cells, sets and chunks, some rows in one cell: as brute force, and as few as one set."""
    monkeypatch.setattr(sim, "SLICE_ROWS", 9)
    for clusters in (0, 9):
        df, m = cloud(spark, 260, clusters=clusters, seed=5)
        want = brute_topk(m, m, 7, exclude)
        for set_bytes in (1, 8 * 8 * 70, 1 << 20):
            got = sim.mips_topk(df, df, 7, query_id="id", doc_id="id", exclude_self=exclude,
                                broadcast_rows=0, block_rows=11, set_bytes=set_bytes)
            assert {(r.query_id, r["rank"], r.doc_id) for r in got.collect()} == want
            near = sim.similarity_range_counts(df, 0.2, 0.6, block_rows=11, set_bytes=set_bytes)
            s = np.round(unit(m) @ unit(m).T, 6)
            inside = ((s >= 0.2) & (s <= 0.6) & ~np.eye(len(m), dtype=bool)).sum(axis=1)
            assert {r.id: r.n_in_range for r in near.collect()} == dict(enumerate(inside))


def test_copies_do_not_grow_with_the_table(spark, monkeypatch):
    """A row of either side meets a bounded number of units, four times the rows or not; blocks
    were once met by every chunk, so copies grew with the table."""
    copies, whole = {}, sim.join_blocks

    def counting(left, right, *rest):
        copies[n].append((left.count() / n, right.count() / n))
        return whole(left, right, *rest)
    monkeypatch.setattr(sim, "join_blocks", counting)
    for n in (2100, 8400):
        copies[n] = []
        df = spark.range(n).select("id", F.array(*[F.randn(i) for i in range(16)]).alias("embedding"))
        sim.mips_topk(df, df, 3, query_id="id", doc_id="id", broadcast_rows=0, block_rows=64)
        sim.similarity_range_counts(df, 0.1, 0.5, block_rows=64)
    for seen in copies.values():
        assert len(seen) == 3 and max(x for both in seen for x in both) <= sim.GROUPS


def test_cells_leave_out_blocks(spark):
    """On clustered data most blocks are never met, and the result is still exact."""
    df, m = cloud(spark, 600, d=6, seed=3, clusters=12)
    base = df.select("id", F.col("embedding").alias("v"))
    cells = sim.build_cells(base, 20)
    queries = sim.chunk_queries(base, cells, 20).withColumn("floor", F.lit(0.9))
    met = sim.route(queries, cells, lambda low, high, floor: high >= floor).count()
    assert met < 0.6 * 600 * sum(cells.blocks)
    low, high = cells.bounds(unit(m))
    cell = sim.place_in_blocks(base, cells, "b").select("id", "cell", "b").collect()
    of = {r.id: r.cell for r in cell}
    s = unit(m) @ unit(m).T
    for j in range(600):
        assert (s[:, j] <= high[:, of[j]]).all() and (s[:, j] >= low[:, of[j]]).all()
    assert max(np.bincount([r.b for r in cell])) < 60


@pytest.mark.parametrize("block_rows", [13, 1000])
def test_range_counts_and_self_similarity(spark, block_rows):
    df, m = cloud(spark, 70)
    s = np.round(unit(m) @ unit(m).T, 6)
    off = ~np.eye(len(m), dtype=bool)
    inside = (s >= 0.2) & (s <= 0.6) & off
    got = {r.id: r for r in sim.similarity_range_counts(df, 0.2, 0.6, block_rows=block_rows)
           .collect()}
    assert {i: got[i].n_in_range for i in got} == {i: int(inside[i].sum()) for i in range(70)}
    for i in range(70):
        if inside[i].any():
            assert math.isclose(got[i].mean_sim, s[i][inside[i]].mean(), abs_tol=1e-9)
        else:
            assert got[i].mean_sim is None and got[i].min_sim is None
    r = sim.self_similarity(df, block_rows=block_rows).first()
    x = np.round((unit(m) @ unit(m).T)[off], 6)
    assert r.n == 70 * 69
    for name, want in (("mean", x.mean()), ("median", np.median(x)), ("std", x.std()),
                       ("min", x.min()), ("max", x.max()), ("q25", np.percentile(x, 25)),
                       ("q75", np.percentile(x, 75)), ("pct_above", 100 * (x > 0.5).mean())):
        assert math.isclose(r[name], want, abs_tol=1e-9), name


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_moments(spark, n):
    df, m = cloud(spark, n)
    r = sim.self_similarity_moments(df).first()
    if n < 2:
        assert not r.n_pairs and r.mean_sim is None
        return
    s = (unit(m) @ unit(m).T)[~np.eye(n, dtype=bool)]
    assert r.n_pairs == n * (n - 1)
    assert math.isclose(r.mean_sim, s.mean(), abs_tol=1e-9)
    assert math.isclose(r.std_sim, s.std(), abs_tol=1e-7)


def test_ranked_negatives(spark):
    df, m = cloud(spark, 40)
    ranked = {(i, j): r for i, r, j in brute_topk(m, m, 11, True)}

    def ranks(strategy):
        out: dict = {}
        for r in sim.ranked_negatives(df, 3, strategy, 11).collect():
            assert ranked[(r.id, r.neg_id)] == r["rank"]
            out.setdefault(r.id, []).append(r["rank"])
        return {tuple(sorted(v)) for v in out.values()}

    assert ranks("hardest") == {(1, 2, 3)} and ranks("semi-hard") == {(5, 6, 7)}
    assert all(len(v) == 3 for v in ranks("random"))
    with pytest.raises(ValueError):
        sim.ranked_negatives(df, 3, "easiest")
