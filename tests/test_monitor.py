from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tripletspark.operators import monitor as mo


def runs(spark, series):
    rows = [(r, i, float(v)) for r, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "run string, i long, loss double")


def series(seed=1):
    rng = random.Random(seed)
    out = {f"r{k}": [round(rng.random(), 2) for _ in range(rng.randint(1, 40))] for k in range(5)}
    out["hot"] = [round(rng.random(), 3) for _ in range(300)]
    return out


SHAPES = [{}, {"chunks": 9, "segment": 7}, {"chunks": 40, "segment": 1}]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [1, 2, 10])
def test_rolling(spark, shape, n):
    data = series()
    got = {(r.run, r.step_no): (r.rolling_mean, r.rolling_min, r.rolling_max)
           for r in mo.rolling_window(runs(spark, data), "run", "i", "loss", n, **shape).collect()}
    assert len(got) == sum(map(len, data.values()))
    for run, xs in data.items():
        for i in range(len(xs)):
            w = xs[max(0, i - n + 1):i + 1]
            mean, low, high = got[(run, i)]
            assert math.isclose(mean, sum(w) / len(w), abs_tol=1e-9)
            assert (low, high) == (min(w), max(w))


def test_rolling_known(spark):
    got = mo.rolling_window(runs(spark, {"a": [1, 2, 3, 4]}), "run", "i", "loss", 2)
    assert [r.rolling_mean for r in got.orderBy("i").collect()] == [1, 1.5, 2.5, 3.5]


@pytest.mark.parametrize("shape", SHAPES)
def test_step_rate(spark, shape):
    df = runs(spark, {"a": [0, .5, 2, 2], "hot": list(range(100))})
    got = mo.step_rate(df, "run", F.col("loss"), "i", **shape)
    a = [r.steps_per_sec for r in got.filter("run = 'a'").orderBy("i").collect()]
    assert a[0] is None and math.isclose(a[1], 2, rel_tol=1e-6)
    assert math.isclose(a[2], 1 / 1.5, rel_tol=1e-6) and math.isclose(a[3], 1e8, rel_tol=1e-6)
    assert got.filter("run = 'hot' and steps_per_sec is null").count() == 1


def stop_by_hand(xs, patience):
    best, best_i, wait = math.inf, None, 0
    for i, x in enumerate(xs):
        if x < best:
            best, best_i, wait = x, i, 0
        else:
            wait += 1
            if wait >= patience:
                return best_i + 1, best, i + 1
    return best_i + 1, best, None


@pytest.mark.parametrize("chunks", [None, 6, 50])
@pytest.mark.parametrize("patience", [1, 2, 5])
def test_early_stopping(spark, chunks, patience):
    data = {**series(2), "flat": [1.0] * 12, "falling": [float(-i) for i in range(60)]}
    got = {r.run: (r.best_step, r.best_loss, r.stop_step) for r in mo.early_stopping(
        runs(spark, data), "run", "i", "loss", patience, chunks=chunks).collect()}
    assert got == {k: stop_by_hand(v, patience) for k, v in data.items()}


def test_early_stopping_known(spark):
    df = runs(spark, {"a": [5, 4, 4, 4.5, 3]})
    r = mo.early_stopping(df, "run", "i", "loss", 3).first()
    assert (r.best_step, r.stop_step, r.stopped) == (5, None, False)
    r = mo.early_stopping(df, "run", "i", "loss", 2).first()
    assert (r.best_step, r.best_loss, r.stop_step) == (2, 4, 4)


def test_summary(spark):
    df = spark.createDataFrame(
        [("a", 0, 2.0, .1, 50.0), ("a", 1, .5, .9, 30.0), ("a", 2, 1.0, .6, 10.0),
         ("z", 0, 0.0, .1, 90.0)],
        "run string, i int, loss double, separation double, violations_pct double")
    rows = {r.run: r for r in mo.training_summary(df, "run", F.col("i"), F.col("i") * 2.0).collect()}
    a = rows["a"]
    assert (a.first_loss, a.last_loss, a.best_loss, a.best_separation) == (2.0, 1.0, .5, .9)
    assert (a.loss_reduction_pct, a.elapsed_sec) == (50.0, 4.0)
    assert (a.loss_fell, a.separated, a.few_violations) == (True, True, True)
    assert rows["z"].loss_reduction_pct is None and not rows["z"].loss_fell
