from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import functions as F

from tripletspark.operators import models as md
from tripletspark.operators.quality import remaining


def items(spark, n=20):
    return spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text"),
                                 F.when(F.col("id") % 2 == 0, "x").alias("maybe"))


def echo():
    return lambda batch: [m[-1]["content"] + "+" for m in batch]


def test_chain(spark):
    steps = [md.Step("sys", "text", "a"), md.Step("{p}/{q}", "a", "b", {"p": "maybe", "q": "a"}),
             md.Step("again", "b", "b", runs=2)]
    rows = {r.id: r for r in md.apply_chain(items(spark), steps, echo, batch=3).collect()}
    assert rows[4].a == "t4+" and rows[4].b == "x/t4++++" and rows[4].status == "ok"
    assert rows[5].b == "/t5++++" and len(rows) == 20


def test_model_made_once_per_task_and_called_once_per_row(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        with open(log, "a") as f:
            f.write(json.dumps(["made"]) + "\n")

        def model(batch):
            with open(log, "a") as f:
                f.write(json.dumps([m[-1]["content"] for m in batch]) + "\n")
            return ["ok"] * len(batch)
        return model

    out = md.apply_chain(items(spark, 10).coalesce(1), [md.Step("s", "text", "a")], make, batch=4)
    assert out.count() == 10
    lines = [json.loads(x) for x in open(log)]
    assert lines[0] == ["made"] and [len(x) for x in lines[1:]] == [4, 4, 2]


def test_failed_batch_is_retried(spark):
    def moody():
        def model(batch):
            if any(m[-1]["content"] == "t5" for m in batch):
                raise RuntimeError("down")
            return ["fine"] * len(batch)
        return model

    df = items(spark, 8).coalesce(1)
    out = md.apply_chain(df, [md.Step("s", "text", "a"), md.Step("s", "a", "b")], moody, batch=2)
    rows = {r.id: r for r in out.collect()}
    assert {i for i, r in rows.items() if r.status == "failed"} == {4, 5}
    assert rows[4].a is None and rows[4].b is None and "down" in rows[4].error
    assert sorted(r.id for r in remaining(df, md.done_rows(out, "id"), "id").collect()) == [4, 5]


def test_short_answer_is_a_failure(spark):
    rows = md.apply_chain(items(spark, 4), [md.Step("s", "text", "a")], lambda: lambda b: ["x"] * 9)
    assert {r.status for r in rows.collect()} == {"failed"}


def test_judge(spark):
    def model():
        def run(batch):
            if any("Feedback:\nt3" in m[-1]["content"] for m in batch):
                raise RuntimeError("refused")
            return ['{"quality_score": 70}' if "Feedback:\nt1" not in m[-1]["content"] else "hm"
                    for m in batch]
        return run

    df = items(spark, 5).withColumn("text", F.when(F.col("id") == 4, "").otherwise(F.col("text")))
    rows = {r.id: r.text_validation for r in
            md.judge(df, ["text"], model, code_col="maybe").collect()}
    assert rows[0].quality_score == 70 and rows[1].issues == ["JSON parsing failed"]
    assert rows[3].issues == ["Validation error: refused"] and rows[2].quality_score == 70
    assert rows[4] is None


def test_embed(spark):
    def make():
        return lambda texts: [[float(len(t)), 0.0, 1.0] for t in texts]
    out = md.embed(items(spark, 5), "text", make, batch=2)
    assert {tuple(r.embedding) for r in out.collect()} == {(2.0, 0.0, 1.0)}
    cut = md.embed(items(spark, 5), "text", make, max_chars=1, normalize=True).first().embedding
    assert np.isclose(np.linalg.norm(cut), 1)
    twice = items(spark, 6).withColumn("text", F.lit("same"))
    assert md.embed_distinct(twice, "text", lambda d: md.embed(d, "text", make)).count() == 6


def test_default_encoder_and_projection(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma delta"), (4, "")],
                               "id int, text string")
    out = {r.id: np.array(r.embedding) for r in md.embed_default(df, "text", dims=64).collect()}
    assert np.allclose(out[1], out[2]) and np.isclose(np.linalg.norm(out[1]), 1)
    assert np.isclose(out[1] @ out[3], 0, atol=1e-6) and not out[4].any()
    rng = np.random.default_rng(0)
    m = rng.normal(size=(80, 5)) * [5, 3, 1, .5, .1]
    vec = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                                "id int, embedding array<double>")
    coords, shares = md.project(vec, 3)
    assert all(len(r.coords) == 3 for r in coords.collect())
    assert shares[0] >= shares[1] >= shares[2] and 0.9 < sum(shares) <= 1.0 + 1e-9


def test_default_encoder_against_counting(spark):
    """Signs, weights and clashes of dimensions; nulls, other columns, any partitioning."""
    texts = ["one two two three", "Two THREE four_4", None, "", "!?", "é É one", "one " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                               "id int, text string, embedding_of string")
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    for dims in (4, 64):
        def slot(w):
            h = hashlib.md5(w.encode()).hexdigest()
            return int(h[:8], 16) % dims, 1 if int(h[8], 16) < 8 else -1
        hit = [sum(d in {slot(w)[0] for w in ws} for ws in words) for d in range(dims)]
        want = np.zeros((len(texts), dims))
        for i, ws in enumerate(words):
            for w in ws:
                d, sign = slot(w)
                want[i, d] += sign * np.log((len(texts) + 1) / (hit[d] + 1))
        length = np.linalg.norm(want, axis=1, keepdims=True)
        want = np.divide(want, length, out=np.zeros_like(want), where=length > 0)
        for parts in (1, 5):
            got = md.embed_default(df.repartition(parts), "text", dims=dims)
            assert got.columns == [*df.columns, "embedding"]
            rows = {r.id: r.embedding for r in got.collect()}
            assert np.allclose([rows[i] for i in range(len(texts))], want, atol=1e-6)
    assert md.embed_default(df.limit(0), "text").count() == 0


def test_projection_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 10
    m[5, 2] = np.nan
    clean = np.nan_to_num(m, nan=0.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)],
                               "id int, embedding array<double>")
    _, _, axes = np.linalg.svd(clean - clean.mean(axis=0), full_matrices=False)
    axes = axes[:3] * np.sign(axes[:3][np.arange(3), np.abs(axes[:3]).argmax(axis=1)])[:, None]
    for parts in (1, 7):
        coords, shares = md.project(df.repartition(parts), 3)
        rows = {r.id: r.coords for r in coords.collect()}
        assert np.allclose([rows[i] for i in range(200)], (clean - clean.mean(axis=0)) @ axes.T)
        assert np.allclose(shares, np.linalg.svd(clean - clean.mean(axis=0))[1][:3] ** 2
                           / ((clean - clean.mean(axis=0)) ** 2).sum())
    none, shares = md.project(df.limit(0))
    assert none.count() == 0 and shares == []
    same, shares = md.project(spark.createDataFrame([(1, [2.0, 2.0])] * 3, df.schema))
    assert shares == [0.0, 0.0] and all(r.coords == [0.0, 0.0] for r in same.collect())


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0, 4.0], 3.0), ("a", [9.0, 9.0], 0.0),
                                ("z", [1.0, 1.0], 0.0)], "g string, embedding array<float>, w double")
    rows = {r.g: r.embedding for r in md.mean_pool(df, ["g"], weight="w").collect()}
    assert rows == {"a": [2.5, 3.5], "z": [0.0, 0.0]}
