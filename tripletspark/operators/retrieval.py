"""Query sets, relevance joins and retrieval metrics.

One top-k table is enough for all metrics: ``per_query`` folds it into one row per query in
one aggregation, and each metric averages a column of that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.functions.text import truncate_chars
from tripletspark.operators.metrics import union_all
from tripletspark.operators.sampling import sample_n

KS = (1, 5, 10)
CUTOFF = 100


def make_queries(df: DataFrame, n: int, seed: int = 42, *, id_col: str = "code_id",
                 code: str = "code_snippet", feedback: str = "conceptual_feedback") -> DataFrame:
    """(query, relevant_ids, metadata): n sampled rows ask for their own id."""
    own = F.col(id_col).cast("string")
    return sample_n(df.select(id_col, code, feedback), n, id_col, seed).select(
        F.coalesce(code, F.lit("")).alias("query"), F.array(own).alias("relevant_ids"),
        F.struct(own.alias("code_id"),
                 truncate_chars(F.coalesce(feedback, F.lit("")), 100, "...")
                 .alias("expected_feedback")).alias("metadata"))


def qrels_of(queries: DataFrame, query_id: str, relevant_ids: str = "relevant_ids",
             scores: str | None = None) -> DataFrame:
    """(query_id, doc_id, rel) from id lists, or from a map id -> grade."""
    if scores:
        return queries.select(F.col(query_id).alias("query_id"),
                              F.explode(scores).alias("doc_id", "rel"))
    return (queries.select(F.col(query_id).alias("query_id"),
                           F.explode(F.array_distinct(relevant_ids)).alias("doc_id"))
            .withColumn("rel", F.lit(1.0)))


def mark_hits(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Add ``rel`` to retrieved documents: their grade, 0 when not relevant."""
    return (hits.join(qrels.select("query_id", "doc_id", F.col("rel").alias("_rel")),
                      ["query_id", "doc_id"], "left")
            .withColumn("rel", F.coalesce(F.col("_rel").cast("double"), F.lit(0.0)))
            .drop("_rel"))


def mark_hits_by_group(hits: DataFrame, groups: DataFrame, id_col: str,
                       group_col: str) -> DataFrame:
    """As ``mark_hits`` when relevant means "of the query's group": the relevance pairs of
    a group are never listed."""
    q = groups.select(F.col(id_col).alias("query_id"), F.col(group_col).alias("_gq"))
    d = groups.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("_gd"))
    return (hits.join(q, "query_id").join(d, "doc_id")
            .withColumn("rel", (F.col("_gq") == F.col("_gd")).cast("double"))
            .drop("_gq", "_gd"))


def _gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + 1)


def relevance_totals(queries: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(query_id, n_relevant, idcg_<k>...) for every query, also those without relevant
    documents."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = (qrels.withColumn("_r", F.row_number().over(best))
             .filter(F.col("_r") <= max(ks)).groupBy("query_id")
             .agg(*[F.sum(F.when(F.col("_r") <= k, _gain(F.col("rel").cast("double"), F.col("_r"))))
                    .alias(f"idcg_{k}") for k in ks]))
    counts = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    out = (queries.select("query_id").join(counts, "query_id", "left")
           .join(ideal, "query_id", "left"))
    return out.select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
                      *[F.coalesce(f"idcg_{k}", F.lit(0.0)).alias(f"idcg_{k}") for k in ks])


def relevance_totals_by_group(groups: DataFrame, id_col: str, group_col: str,
                              ks: Sequence[int] = KS) -> DataFrame:
    """As ``relevance_totals`` for "same group, not itself", from group sizes alone."""
    sizes = groups.groupBy(group_col).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))

    def ideal(k: int) -> Column:
        ranks = F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int"))
        total = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1))
        return F.when(F.col("n_relevant") > 0, total).otherwise(0.0)

    sizes = sizes.select(group_col, "n_relevant", *[ideal(k).alias(f"idcg_{k}") for k in ks])
    return (groups.select(F.col(id_col).alias("query_id"), group_col)
            .join(sizes, group_col).drop(group_col))


def per_query(marked: DataFrame, totals: DataFrame, ks: Sequence[int] = KS,
              cutoff: int = CUTOFF) -> DataFrame:
    """One row per query: hit_k, found_k, dcg_k, ndcg_k, first_rank, ap, n_relevant."""
    hit = (F.col("rel") > 0).cast("int")
    rank = F.col("rank")
    so_far = F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank")
                             .rowsBetween(Window.unboundedPreceding, 0))
    seen = (marked.filter(rank <= max(cutoff, *ks)).withColumn("_hit", hit)
            .withColumn("_found", so_far))
    cells: list[Column] = []
    for k in ks:
        cells += [F.sum(F.when(rank <= k, F.col("_hit")).otherwise(0)).alias(f"found_{k}"),
                  F.sum(F.when(rank <= k, _gain(F.col("rel"), rank)).otherwise(0.0))
                  .alias(f"dcg_{k}")]
    relevant = (F.col("_hit") == 1) & (rank <= cutoff)
    folded = seen.groupBy("query_id").agg(
        F.min(F.when(relevant, rank)).alias("first_rank"),
        F.sum(F.when(relevant, F.col("_found") / rank).otherwise(0.0)).alias("_ap"), *cells)
    out = totals.join(folded, "query_id", "left")
    columns = [F.col("query_id"), F.col("n_relevant"), F.col("first_rank"),
               F.when(F.col("n_relevant") > 0,
                      F.coalesce("_ap", F.lit(0.0)) / F.col("n_relevant")).alias("ap")]
    for k in ks:
        found = F.coalesce(f"found_{k}", F.lit(0))
        dcg = F.coalesce(f"dcg_{k}", F.lit(0.0))
        columns += [(found > 0).cast("double").alias(f"hit_{k}"), found.alias(f"found_{k}"),
                    dcg.alias(f"dcg_{k}"),
                    F.coalesce(F.try_divide(dcg, F.col(f"idcg_{k}")), F.lit(0.0))
                    .alias(f"ndcg_{k}")]
    return out.select(*columns)


def _averages(queries: DataFrame, cells: Sequence[tuple[str, int | None, Column]]) -> DataFrame:
    """Rows (metric, k, value) from averages computed in one aggregation."""
    wide = queries.agg(*[c.cast("double").alias(f"_{i}") for i, (_, _, c) in enumerate(cells)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(k).cast("int").alias("k"),
                 F.col(f"_{i}").alias("value"))
        for i, (m, k, _) in enumerate(cells)])).alias("m")).select("m.*")


def _hit_rate(k: int):
    return "hit_rate", k, F.avg(f"hit_{k}")


def _recall(k: int):
    return "recall", k, F.avg(F.when(F.col("n_relevant") > 0,
                                     F.col(f"found_{k}") / F.col("n_relevant")).otherwise(0.0))


def _precision(k: int):
    return "precision", k, F.avg(F.col(f"found_{k}") / F.lit(k))


def _ndcg(k: int):
    return "ndcg", k, F.avg(f"ndcg_{k}")


def _mrr():
    return "mrr", None, F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def _map():
    return "map", None, F.avg("ap")  # null for queries without relevant ids: left out


def recall_at_k(queries: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """``hit_rate``: share of queries with a relevant document in the top k.
    ``recall``: mean share of the relevant documents found there."""
    return _averages(queries, [f(k) for f in (_hit_rate, _recall) for k in ks])


def mrr(queries: DataFrame) -> DataFrame:
    return _averages(queries, [_mrr()])


def ndcg_at_k(queries: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    return _averages(queries, [_ndcg(k) for k in ks])


def map_at(queries: DataFrame) -> DataFrame:
    return _averages(queries, [_map()])


def precision_at_k(queries: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    return _averages(queries, [_precision(k) for k in ks])


def retrieval_report(queries: DataFrame, corpus: DataFrame,
                     ks: Sequence[int] = KS) -> DataFrame:
    """All metrics, number of queries and size of the corpus, as rows (metric, k, value)."""
    cells = [f(k) for f in (_hit_rate, _recall, _precision) for k in ks]
    cells += [_ndcg(k) for k in ks if k > 1]
    cells += [_mrr(), _map(), ("n_queries", None, F.count(F.lit(1)))]
    size = corpus.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("n_corpus").alias("metric"), F.lit(None).cast("int").alias("k"), "value")
    return union_all([_averages(queries, cells), size])


def rank_within(df: DataFrame, key: str, score: str, k: int, tie_cols: Sequence[str] = (),
                out: str = "rank") -> DataFrame:
    """The k rows of largest score per key, ranked from 1. The filter on the rank lets
    Spark keep only k rows per key and map task before the shuffle."""
    best = Window.partitionBy(key).orderBy(F.desc(score), *tie_cols)
    return df.withColumn(out, F.row_number().over(best)).filter(F.col(out) <= k)
