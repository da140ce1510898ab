from __future__ import annotations

import math

from pyspark.sql import functions as F

from tripletspark.operators import retrieval as rt

HITS = "query_id string, rank int, doc_id string"
QRELS = "query_id string, doc_id string, rel double"


def folded(spark, hits, qrels, queries, ks=(1, 5)):
    h = spark.createDataFrame(hits, HITS)
    q = spark.createDataFrame(qrels, QRELS)
    asked = spark.createDataFrame([(x,) for x in queries], "query_id string")
    return rt.per_query(rt.mark_hits(h, q), rt.relevance_totals(asked, q, ks), ks)


def as_dict(df):
    return {(r.metric, r.k): r.value for r in df.collect()}


def test_known_answers(spark):
    docs = ["a", "b", "c", "d", "e"]
    per = folded(spark, [("q", i + 1, d) for i, d in enumerate(docs)], [("q", "c", 1.0)], ["q"])
    m = as_dict(rt.retrieval_report(per, spark.range(5), (1, 5)))
    assert m[("hit_rate", 1)] == 0 and m[("hit_rate", 5)] == 1 and m[("recall", 5)] == 1
    assert math.isclose(m[("mrr", None)], 1 / 3) and math.isclose(m[("ndcg", 5)], .5)
    assert math.isclose(m[("precision", 5)], .2)
    assert m[("n_queries", None)] == 1 and m[("n_corpus", None)] == 5
    assert ("ndcg", 1) not in m


def test_three_relevant_two_found(spark):
    per = folded(spark, [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")],
                 [("q", "a", 1.0), ("q", "c", 1.0), ("q", "missing", 1.0)], ["q"])
    assert math.isclose(as_dict(rt.recall_at_k(per, [5]))[("recall", 5)], 2 / 3)
    assert math.isclose(as_dict(rt.ndcg_at_k(per, [5]))[("ndcg", 5)], .703918, abs_tol=1e-6)
    assert math.isclose(as_dict(rt.map_at(per))[("map", None)], .555556, abs_tol=1e-6)


def test_graded(spark):
    per = folded(spark, [("q", 1, "a"), ("q", 2, "b")], [("q", "a", 1.0), ("q", "b", 3.0)], ["q"])
    assert math.isclose(as_dict(rt.ndcg_at_k(per, [5]))[("ndcg", 5)], .796708, abs_tol=1e-6)


def test_queries_without_hits_or_relevant_ids(spark):
    per = folded(spark, [("q", 3, "a"), ("none", 1, "a")],
                 [("q", "a", 1.0), ("lost", "z", 1.0)], ["q", "lost", "none"])
    assert math.isclose(as_dict(rt.mrr(per))[("mrr", None)], (1 / 3) / 3)
    # MAP leaves out the query without relevant ids, the other metrics count it.
    assert math.isclose(as_dict(rt.map_at(per))[("map", None)], (1 / 3) / 2)
    assert math.isclose(as_dict(rt.recall_at_k(per, [5]))[("hit_rate", 5)], 1 / 3)


def test_cutoff(spark):
    per = folded(spark, [("q", 101, "a")], [("q", "a", 1.0)], ["q"])
    assert as_dict(rt.mrr(per))[("mrr", None)] == 0
    assert as_dict(rt.map_at(per))[("map", None)] == 0


def test_groups_equal_listed_qrels(spark):
    groups = spark.range(60).select("id", (F.col("id") % 7).alias("g"))
    hits = groups.select(F.col("id").alias("query_id")).join(
        spark.range(1, 11).select(F.col("id").alias("rank")), F.lit(True)).withColumn(
        "doc_id", (F.col("query_id") * 3 + F.col("rank") * 5) % 60).filter("doc_id <> query_id")
    hits = hits.dropDuplicates(["query_id", "doc_id"])
    qrels = (groups.alias("a").join(groups.alias("b"), F.expr("a.g = b.g and a.id <> b.id"))
             .selectExpr("a.id query_id", "b.id doc_id", "1.0D rel"))
    by_list = rt.per_query(rt.mark_hits(hits, qrels), rt.relevance_totals(
        groups.select(F.col("id").alias("query_id")), qrels))
    by_group = rt.per_query(rt.mark_hits_by_group(hits, groups, "id", "g"),
                            rt.relevance_totals_by_group(groups, "id", "g"))

    def rows(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                       for r in df.collect()), key=repr)
    assert rows(by_list) == rows(by_group)


def test_make_queries_and_qrels(spark):
    df = spark.createDataFrame([("c1", "code", "f" * 200), ("c2", None, None)],
                               "code_id string, code_snippet string, conceptual_feedback string")
    q = rt.make_queries(df, 5)
    rows = {r.metadata.code_id: r for r in q.collect()}
    assert rows["c1"].relevant_ids == ["c1"]
    assert rows["c1"].metadata.expected_feedback == "f" * 100 + "..."
    assert rows["c2"].query == "" and rows["c2"].metadata.expected_feedback == "..."
    qrels = rt.qrels_of(q.withColumn("qid", F.col("metadata.code_id")), "qid")
    assert {(r.query_id, r.doc_id, r.rel) for r in qrels.collect()} == {
        ("c1", "c1", 1.0), ("c2", "c2", 1.0)}
    graded = spark.createDataFrame([("q", {"a": 2.0, "b": 1.0})], "q string, s map<string,double>")
    assert rt.qrels_of(graded, "q", scores="s").count() == 2


def test_rank_within_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("s"))
    ranked = rt.rank_within(df, "k", "s", 2)
    assert sorted((r.k, r["rank"], r.s) for r in ranked.collect()) == [
        (0, 1, 998), (0, 2, 996), (1, 1, 999), (1, 2, 997)]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
