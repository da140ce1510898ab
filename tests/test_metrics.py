from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletspark.operators import metrics as mt
from tripletspark.operators import triplets as tr
from tripletspark.operators.quality import drop_legacy


def test_similarity_stats_known(spark):
    df = spark.createDataFrame([(.2,), (.4,), (.6,), (.8,)], "s double")
    r = mt.similarity_stats(df, "s").first()
    want = {"mean": .5, "median": .5, "std": .223607, "q25": .35, "q75": .65, "pct_above": 50.0,
            "min": .2, "max": .8, "n": 4}
    assert all(math.isclose(r[k], v, abs_tol=1e-6) for k, v in want.items())
    assert mt.similarity_stats(df.limit(0), "s").first().n == 0


@pytest.mark.parametrize("values, bins", [([0, 1, 2, 3, 4], 2), ([5, 5, 5], 4), ([1.5], 3),
                                          (list(range(100)), 7)])
def test_histogram_is_numpys(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts, edges = np.histogram(values, bins)
    rows = sorted(mt.histogram(df, "x", bins).collect())
    assert [r.n for r in rows] == counts.tolist()
    assert np.allclose([r.lo for r in rows] + [rows[-1].hi], edges)


def test_histogram_of_nothing(spark):
    assert mt.histogram(spark.createDataFrame([], "x double"), "x", 5).count() == 0


def test_threshold_metrics_known(spark):
    df = spark.createDataFrame([(.1, 1), (.6, 1), (.4, 0), (.9, 0)], "d double, y int")
    r = mt.threshold_metrics(df, "d", "y", [0.5]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (.5, .5, .5, .5)
    strict = mt.threshold_metrics(df, "d", "y", [0.1]).first()
    assert (strict.tp, strict.precision, strict.f1) == (0, 0.0, 0.0)
    empty = mt.threshold_metrics(df.limit(0), "d", "y", [0.5]).first()
    assert empty.accuracy == 0.0


def test_auc(spark):
    df = spark.createDataFrame([(.1, 1), (.5, 1), (.5, 0), (.9, 0)], "d double, y int")
    assert mt.roc_auc(df, "d", "y").first().auc == 0.875
    assert math.isnan(mt.roc_auc(df.filter("y = 1"), "d", "y").first().auc)
    rng = random.Random(3)
    rows = [(round(rng.random() * 2, 2), rng.randint(0, 1)) for _ in range(400)]
    got = mt.roc_auc(spark.createDataFrame(rows, "d double, y int").repartition(9), "d", "y")
    p, q = [d for d, y in rows if y], [d for d, y in rows if not y]
    want = np.mean([(a < b) + 0.5 * (a == b) for a in p for b in q])
    assert math.isclose(got.first().auc, want, abs_tol=1e-12)


def test_models(spark):
    df = spark.createDataFrame([("a", .7), ("b", .9), ("c", .7)], "model string, auc double")
    ranks = {r.model: r["rank"] for r in mt.rank_models(df, "auc").collect()}
    assert ranks == {"b": 1, "a": 2, "c": 3}
    s = mt.model_spread(df, "auc").first()
    assert (s.best_model, s.choice_matters) == ("b", True) and s.worst_score == .7


def test_report_json(spark):
    long = spark.createDataFrame([("recall", 1, .5), ("recall", 5, .75), ("mrr", None, .6)],
                                 "metric string, k int, value double")
    assert json.loads(mt.metrics_json(long).first().report) == {
        "recall": {"1": .5, "5": .75}, "mrr": {"all": .6}}
    wide = spark.createDataFrame([(1, 2.5)], "a int, b double")
    assert {(r.metric, r.value) for r in mt.metrics_long(wide, ["a", "b"]).collect()} == {
        ("a", 1.0), ("b", 2.5)}


def test_judgement_summary(spark):
    v = "struct<quality_score:double,is_factually_correct:boolean,is_conceptually_clear:boolean," \
        "is_applicable:boolean,needs_correction:boolean>"
    df = spark.createDataFrame([((80.0, True, None, True, False),), ((None, True, True, False, True),),
                                (None,)], f"x {v}")
    r = mt.judgement_summary(df, {"x": "x"}).first()
    assert (r.n_judged, r.mean_score, r.n_factually_correct, r.n_conceptually_clear) == (2, 40, 2, 1)
    assert r.pct_needs_correction == 50.0


def test_corpus_and_dataset_stats(spark):
    df = spark.createDataFrame([("ab", ["x"], [1.0, 2.0]), ("abcd", None, [1.0, 2.0])],
                               "t string, l array<string>, v array<double>")
    r = mt.dataset_stats(df, "t", "l").first()
    assert (r.n_examples, r.n_negatives, r.mean_negatives, r.mean_code_chars) == (2, 1, .5, 3)
    c = mt.corpus_stats(df, "t", df, "v").first()
    assert (c.n_documents, c.mean_chars, c.n_embeddings, c.dimension) == (2, 3.0, 2, 2)
    s = mt.item_stats(df, "t", "t", "l").collect()
    assert [(r.code_chars, r.n_negatives) for r in s] == [(2, 1), (4, 0)]


# ------------------------------------------------------------------------------- triplets

def dist(spark, rows):
    return spark.createDataFrame(rows, "id int, neg_pos int, pos_dist double, neg_dist double")


def test_loss_and_metrics_known(spark):
    d = dist(spark, [(1, 0, .4, .5), (1, 1, .4, 1.2)])
    assert math.isclose(tr.triplet_loss(d, .5).first().loss, .2)
    r = tr.triplet_metrics(d, .5).first()
    assert (r.violations, r.violations_pct, r.hard_triplets) == (1, 50.0, 1)
    one = tr.triplet_metrics(d.filter("neg_pos = 0"), .5).first()
    assert one.pos_dist_std is None
    assert tr.triplet_metrics(d.limit(0), .5).first().violations_pct is None
    v = tr.validation_metrics(d, .5).first()
    assert v.n_examples == 1 and math.isclose(v.separation, .1)
    assert tr.triplet_accuracy(d).first().accuracy == 1.0


def test_batch_means(spark):
    d = dist(spark, [(i, 0, .5, .5 + .1 * i) for i in range(3)]).withColumn(
        "batch", (F.col("id") / 2).cast("int"))
    r = tr.triplet_loss(d, .5, "batch").first()
    assert math.isclose(r.loss, .4) and math.isclose(r.batch_mean_loss, (.45 + .3) / 2)


def test_separation_report(spark):
    d = dist(spark, [(1, 0, .2, .6), (1, 1, .2, .8), (2, 0, .4, 1.0)]).withColumn(
        "model", F.lit("a"))
    r = tr.separation_report(d).first()
    assert math.isclose(r.avg_pos, .3) and math.isclose(r.avg_neg, .8)
    assert math.isclose(r.median_pos, .3) and math.isclose(r.median_neg, .8) and r["rank"] == 1


def test_item_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (1, [1.0, 0.0], [0.0, 1.0])],
                               "id int, positive array<double>, negative array<double>")
    r = tr.item_similarity(df).first()
    assert (r.mean_sim, r.min_sim, r.max_sim) == (.5, 0.0, 1.0)


def test_resolve_fields(spark):
    df = spark.createDataFrame(
        [("c1", "code", None, "ref", ["n"], "h", 0), (None, "code", "con", "ref", [], "h", 1),
         (None, None, None, None, None, None, 2)],
        "code_id string, code_snippet string, conceptual_feedback string, "
        "refined_feedback string, negative_feedbacks array<string>, "
        "hard_negative_feedback string, pos int")
    good, bad = tr.resolve_fields(df, "pos")
    rows = {r.id: r for r in good.collect()}
    assert (rows["c1"].positive, rows["c1"].negatives) == ("ref", ["n"])
    assert (rows["doc_1"].positive, rows["doc_1"].negatives) == ("con", ["h"])
    assert [r.id for r in bad.collect()] == ["doc_2"]
    bare = spark.createDataFrame([("a", "t")], "id string, text string")
    r = tr.resolve_fields(bare)[0].first()
    assert (r.id, r.anchor, r.positive, r.negatives, r.text) == ("a", "", "", [], "t")


def test_explode_and_graph(spark):
    df = spark.createDataFrame([(1, "a" * 150, "p", ["x", "y"]), (2, "b", "q", [])],
                               "id int, anchor string, positive string, negatives array<string>")
    long = sorted((r.id, r.neg_pos, r.negative, r.n_negatives)
                  for r in tr.explode_triplets(df).collect())
    assert long == [(1, 0, "x", 2), (1, 1, "y", 2)]
    nodes, edges = tr.triplet_graph(df, 10)
    labels = {r.node_id: r.label for r in nodes.collect()}
    item = {r.id: r["item"] for r in nodes.collect()}
    assert set(item.values()) == {1, 2}
    assert labels["1/negative/2"] == f"Neg {item[1]}.2" and labels["2/anchor"] == f"Code {item[2]}"
    assert max(len(r.text) for r in nodes.filter("type = 'anchor'").collect()) == 100
    assert {(r.src, r.dst, r.type) for r in edges.collect()} == {
        ("1/anchor", "1/positive", "positive"), ("1/anchor", "1/negative/1", "negative"),
        ("1/anchor", "1/negative/2", "negative"), ("2/anchor", "2/positive", "positive")}
    shown = {r.label for r in tr.item_graph(df).filter("id = 1").collect()}
    assert shown == {"Anchor (Code)", "Positive", "Negative 1", "Negative 2"}


def test_edits_and_legacy(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    edits = spark.createDataFrame([(1, "A1", None, 1), (1, "A2", None, 2)],
                                  "id int, x string, y string, at int")
    assert sorted(map(tuple, tr.apply_edits(base, edits, "id", ["x", "y"], "at").collect())) == [
        (1, "A2", "b"), (2, "c", "d")]
    legacy = base.withColumn("random_negative", F.lit("z"))
    assert drop_legacy(legacy).columns == ["id", "x", "y"]
