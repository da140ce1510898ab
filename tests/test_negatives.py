from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_similarity import cloud, unit
from tripletspark.operators import negatives as ng


def brute(m, n, lo, hi, strict=True, seed=42):
    """The same definition on a full matrix."""
    size = len(m)
    order = sorted(range(size), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    a = np.empty(size, dtype=int)
    a[order] = np.arange(size)
    s = np.round(unit(m) @ unit(m).T, 6)
    out = set()
    for i in range(size):
        others = [j for j in range(size) if j != i]
        mark = hashlib.md5(f"{seed}:walk:{a[i]}".encode()).hexdigest()[:12]
        step = {j: ((a[j] - a[i] - 1) % size - int(mark, 16) % (size - 1)) % (size - 1)
                for j in others}
        r = sorted((j for j in others if lo <= s[i, j] <= hi), key=lambda j: step[j])
        v = sorted((j for j in others if s[i, j] >= 0 and not lo <= s[i, j] <= hi),
                   key=lambda j: (s[i, j], a[j]))
        chosen = r[:n]
        if len(r) < n:
            need = n - len(r)
            if not r or not strict or len(v) >= need:
                chosen = chosen + v[:need]
        out |= {(i, k + 1, j) for k, j in enumerate(chosen)}
    return out


def triples(df):
    return {(r.id, r["rank"], r.neg_id) for r in df.collect()}


@pytest.mark.parametrize("n, lo, hi", [(2, 0.2, 0.4), (5, 0.5, 0.7), (3, 0.95, 0.99)])
@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "prefix_blocks": 2},
                                     {"block_rows": 30, "prefix_blocks": 1}])
def test_hard_negatives_against_full_matrix(spark, n, lo, hi, options):
    df, m = cloud(spark, 150)
    assert triples(ng.hard_negatives(df, n, lo, hi, **options)) == brute(m, n, lo, hi)


@pytest.mark.parametrize("options", [{}, {"block_rows": 10, "prefix_blocks": 3}])
def test_hard_negatives_partly_filled(spark, options):
    df, m = cloud(spark, 60, d=3)
    got = triples(ng.hard_negatives(df, 40, 0.9, 0.95, strict_fill=False, **options))
    assert got == brute(m, 40, 0.9, 0.95, strict=False)
    assert triples(ng.hard_negatives(df, 40, 0.9, 0.95, **options)) == brute(m, 40, 0.9, 0.95)


@pytest.mark.parametrize("lo, hi", [(0.3, 0.5), (0.9, 0.999), (-0.2, -0.1)])
def test_bounds_leave_cells_out(spark, monkeypatch, lo, hi):
    """On clustered vectors the second phase meets a part of the blocks, with the full result for
    rows that find enough, too little and nothing in the band."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(9, 12))
    m = (np.repeat(centers, 30, axis=0) + rng.normal(size=(270, 12)) * 0.08).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)],
                               "id long, embedding array<float>")
    met, whole = [], ng.meet

    def meet(routed, blocks):
        met.append(routed.count())
        return whole(routed, blocks)
    def build(*args):
        built.append(cells(*args))
        return built[-1]
    built, cells = [], ng.stored_cells
    monkeypatch.setattr(ng, "meet", meet)
    monkeypatch.setattr(ng, "stored_cells", build)
    got = triples(ng.hard_negatives(df, 4, lo, hi, block_rows=10, prefix_blocks=1))
    assert got == brute(m.astype(float), 4, lo, hi)
    assert met and sum(met) < 0.6 * 270 * sum(built[0][0].blocks)


def star(spark, sims):
    """Row 0 has the given cosines to rows 1.."""
    rows = [(0, [1.0] + [0.0] * len(sims))]
    for i, s in enumerate(sims):
        v = [s] + [0.0] * len(sims)
        v[i + 1] = math.sqrt(1 - s * s)
        rows.append((i + 1, v))
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("sims, n, want", [
    ([.1, .25, .35, .6, -.2], 2, {2, 3}),
    ([.1, .25, .35, .6, -.2], 3, {1, 2, 3}),
    ([.1, .25, .35, .6, -.2], 5, {2, 3}),
    ([.1, .6, -.2], 2, {1, 2}),
    ([.2, .4, .41, .19], 2, {1, 2}),       # both ends of the band belong to it
    ([-.1, -.2], 2, set()),
])
def test_known_cases(spark, sims, n, want):
    got = ng.hard_negatives(star(spark, sims), n, 0.2, 0.4).filter("id = 0").collect()
    assert {r.neg_id for r in got} == want


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df, _ = cloud(spark, n)
    got = ng.hard_negatives(df, 3, 0.2, 0.4).collect()
    assert len(got) <= max(0, n * (n - 1))


def test_bad_numbers_are_repaired(spark):
    rows = [(0, [float("nan"), 1.0]), (1, [float("inf"), 1.0]), (2, [0.3, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = ng.hard_negatives(df, 1, 0.9, 1.0).filter("id = 0").first()
    assert got.neg_id in (1, 2) and got.score > 0.9


def test_hybrid(spark):
    df, m = cloud(spark, 40)
    df = df.withColumn("t", F.concat(F.lit("t"), "id"))
    out = ng.hybrid_negatives(df, "t", 5, 2, 0.2, 0.5).collect()
    hard = brute(m, 2, 0.2, 0.5)
    for r in out:
        mine = [f"t{j}" for _, _, j in sorted(x for x in hard if x[0] == r.id)]
        assert r.negative_feedbacks[:len(mine)] == mine
        assert len(set(r.negative_feedbacks)) == len(r.negative_feedbacks)
        assert f"t{r.id}" not in r.negative_feedbacks
        meta = r.negatives_metadata
        assert (meta.total, meta.num_hard) == (len(r.negative_feedbacks), len(mine))
        assert meta.num_easy == 3 and meta.generation_method == "hybrid"
    easy_only = ng.hybrid_negatives(df, "t", 4, 0).collect()
    assert all(r.negatives_metadata.num_easy == 4 for r in easy_only)
    alone = ng.hybrid_negatives(df.filter("id = 5"), "t", 4, 2).first()
    assert alone.negative_feedbacks == [] and alone.negatives_metadata.total == 0


@pytest.mark.parametrize("total, hard, lo, hi", [(2, 3, .2, .4), (2, -1, .2, .4), (0, 0, .2, .4),
                                                 (5, 2, .4, .2), (5, 2, -.1, .4), (5, 2, .2, 1.1)])
def test_hybrid_arguments(spark, total, hard, lo, hi):
    df, _ = cloud(spark, 5)
    with pytest.raises(ValueError):
        ng.hybrid_negative_ids(df, total, hard, lo, hi)


def test_report(spark):
    mined = spark.createDataFrame([(1, 0.2, "in_range"), (2, 0.4, "in_range"), (3, 0.6, "fallback")],
                                  "id int, score double, source string")
    r = ng.mining_report(mined, spark.range(4), 2).first()
    assert (r.n_examples, r.n_in_range, r.pct_in_range, r.n_fallback) == (4, 2, 25.0, 1)
    assert math.isclose(r["mean"], 0.4) and r["median"] == 0.4
    none = ng.mining_report(mined.limit(0), spark.range(0), 2).first()
    assert none.n_in_range == 0 and none.pct_in_range is None
