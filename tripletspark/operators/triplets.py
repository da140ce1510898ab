"""Triplets: field resolution, long form, graph view, edits and distance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.functions.vectors import cosine_similarity, distance, l2_normalize
from tripletspark.operators.indexing import dense_index
from tripletspark.operators.metrics import value_counts
from tripletspark.operators.sampling import sample_n
from tripletspark.session import broadcast_if_small, cut_lineage

def _maybe(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def resolve_fields(df: DataFrame, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with id, anchor, positive, negatives; rejected rows with ``reason``).

    An absent field and a null field are the same. Without an id the row is named after
    ``order_col``.
    """
    def text(*names: str) -> Column:
        return F.coalesce(*[_maybe(df, n, "string") for n in names])

    many = _maybe(df, "negative_feedbacks", "array<string>")
    one = text("hard_negative_feedback", "negative_feedback")
    fallback = F.concat(F.lit("doc_"), F.col(order_col).cast("string")) if order_col \
        else F.lit(None).cast("string")
    out = df.select(
        F.coalesce(text("code_id", "id"), fallback).alias("id"),
        F.coalesce(text("code_snippet", "code"), F.lit("")).alias("anchor"),
        F.coalesce(text("conceptual_feedback", "refined_feedback"), F.lit("")).alias("positive"),
        F.when(F.size(many) > 0, many).when(one.isNotNull(), F.array(one))
        .otherwise(F.array().cast("array<string>")).alias("negatives"),
        text("text", "conceptual_feedback", "feedback").alias("text"))
    known = F.col("text").isNotNull() | (F.col("anchor") != "")
    return (out.filter(known),
            out.filter(~known).withColumn("reason", F.lit("no text, feedback or code field")))


def explode_triplets(df: DataFrame, id_col: str = "id", anchor: str = "anchor",
                     positive: str = "positive", negatives: str = "negatives") -> DataFrame:
    """(id, n_negatives, neg_pos, anchor, positive, negative): one row per negative."""
    return df.select(
        id_col, F.size(negatives).alias("n_negatives"), F.col(anchor).alias("anchor"),
        F.col(positive).alias("positive"), F.posexplode(negatives).alias("neg_pos", "negative"))


def triplet_graph(df: DataFrame, n: int, seed: int = 42, *, id_col: str = "id",
                  anchor: str = "anchor", positive: str = "positive",
                  negatives: str = "negatives") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of n sampled items. Node ids come from (item, role, position), so
    they do not depend on the order in which tasks run."""
    picked = sample_n(df.select(id_col, anchor, positive, negatives), n, id_col, seed)
    numbered = (dense_index(picked, id_col, seed=seed, out="item")
                .withColumn("item", F.col("item") + 1))
    key = F.col(id_col).cast("string")
    nodes = numbered.select(F.col(id_col), "item", F.explode(F.concat(
        F.array(
            F.struct(F.concat_ws("/", key, F.lit("anchor")).alias("node_id"),
                     F.lit("anchor").alias("type"),
                     F.concat(F.lit("Code "), F.col("item")).alias("label"),
                     F.substring(anchor, 1, 100).alias("text")),
            F.struct(F.concat_ws("/", key, F.lit("positive")).alias("node_id"),
                     F.lit("positive").alias("type"),
                     F.concat(F.lit("Pos "), F.col("item")).alias("label"),
                     F.col(positive).alias("text"))),
        F.transform(F.col(negatives), lambda x, i: F.struct(
            F.concat_ws("/", key, F.lit("negative"), (i + 1).cast("string")).alias("node_id"),
            F.lit("negative").alias("type"),
            F.concat(F.lit("Neg "), F.col("item"), F.lit("."), i + 1).alias("label"),
            x.alias("text"))))).alias("n")).select(id_col, "item", "n.*")
    edges = (nodes.filter("type <> 'anchor'")
             .select(F.concat_ws("/", key, F.lit("anchor")).alias("src"),
                     F.col("node_id").alias("dst"), "type"))
    return nodes, edges


def item_graph(df: DataFrame, *, anchor: str = "anchor", positive: str = "positive",
               negatives: str = "negatives", id_col: str = "id") -> DataFrame:
    """Nodes of single items under their display labels."""
    return df.select(F.col(id_col), F.explode(F.concat(
        F.array(F.struct(F.lit("anchor").alias("type"), F.lit("Anchor (Code)").alias("label"),
                         F.col(anchor).alias("text")),
                F.struct(F.lit("positive").alias("type"), F.lit("Positive").alias("label"),
                         F.col(positive).alias("text"))),
        F.transform(F.col(negatives), lambda x, i: F.struct(
            F.lit("negative").alias("type"),
            F.concat(F.lit("Negative "), i + 1).alias("label"), x.alias("text"))))
    ).alias("n")).select(id_col, "n.*")


def apply_edits(base: DataFrame, edits: DataFrame, key: str, cols: Sequence[str],
                order_col: str) -> DataFrame:
    """The latest edit of a row replaces its stored values; null in an edit keeps them."""
    latest = edits.groupBy(key).agg(F.max_by(
        F.struct(*[F.col(c) for c in cols]), order_col).alias("_e"))
    out = base.join(broadcast_if_small(cut_lineage(latest)), key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col("_e")[c], F.col(c)))
    return out.drop("_e").select(*base.columns)


# ------------------------------------------------------------------ distances, metrics

def triplet_distances(df: DataFrame, name: str = "cosine", *, unit: bool = True,
                      keep: Sequence[str] = ("id", "neg_pos")) -> DataFrame:
    """``keep`` columns + pos_dist, neg_dist from vectors anchor, positive, negative."""
    a, p, n = F.col("anchor"), F.col("positive"), F.col("negative")
    if unit and name != "cosine":
        df = (df.withColumn("anchor", l2_normalize(a)).withColumn("positive", l2_normalize(p))
              .withColumn("negative", l2_normalize(n)))
    return df.select(*keep, distance(name, a, p).alias("pos_dist"),
                     distance(name, a, n).alias("neg_dist"))


def _loss(margin: float) -> Column:
    return F.greatest(F.col("pos_dist") + margin - F.col("neg_dist"), F.lit(0.0))


def triplet_loss(dist: DataFrame, margin: float = 0.5, batch_col: str | None = None,
                 id_col: str = "id") -> DataFrame:
    """Mean over examples of the mean loss over their negatives. With ``batch_col`` the
    mean of batch means is added, which weights a short last batch more."""
    keys = [id_col, *([batch_col] if batch_col else [])]
    per_example = dist.groupBy(*keys).agg(F.avg(_loss(margin)).alias("loss"))
    if not batch_col:
        return per_example.agg(F.avg("loss").alias("loss"),
                               F.count(F.lit(1)).alias("n_examples"))
    return (per_example.groupBy(batch_col)
            .agg(F.avg("loss").alias("m"), F.sum("loss").alias("s"),
                 F.count(F.lit(1)).alias("c"))
            .agg((F.sum("s") / F.sum("c")).alias("loss"), F.sum("c").alias("n_examples"),
                 F.avg("m").alias("batch_mean_loss")))


def triplet_metrics(dist: DataFrame, margin: float = 0.5,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    loss = _loss(margin)
    n = F.count(F.lit(1))
    return dist.groupBy(*group_cols).agg(
        n.alias("n_triplets"), F.avg(loss).alias("loss"),
        F.avg("pos_dist").alias("pos_dist_mean"), F.stddev_samp("pos_dist").alias("pos_dist_std"),
        F.avg("neg_dist").alias("neg_dist_mean"), F.stddev_samp("neg_dist").alias("neg_dist_std"),
        F.count_if(loss > 0).alias("violations"),
        F.try_divide(100.0 * F.count_if(loss > 0), n).alias("violations_pct"),
        F.avg(F.col("neg_dist") - F.col("pos_dist")).alias("separation"),
        F.count_if(loss > margin / 2).alias("hard_triplets"))


def validation_metrics(dist: DataFrame, margin: float = 0.5) -> DataFrame:
    """Means, violation percentage and separation on the first negative of each example."""
    loss = _loss(margin)
    return dist.filter("neg_pos = 0").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.avg("pos_dist").alias("pos_dist"), F.avg("neg_dist").alias("neg_dist"),
        F.try_divide(100.0 * F.count_if(loss > 0), F.count(F.lit(1))).alias("violations_pct"),
        F.avg(F.col("neg_dist") - F.col("pos_dist")).alias("separation"))


def triplet_accuracy(dist: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return dist.groupBy(*group_cols).agg(
        F.avg((F.col("pos_dist") < F.col("neg_dist")).cast("double")).alias("accuracy"))


def separation_report(dist: DataFrame, model: str = "model") -> DataFrame:
    """Per model: mean and median distance to positives (one per item) and to negatives
    (pooled), the margin between the means, and the rank by margin. Medians are taken at
    six decimals."""
    sides = dist.select(model, F.explode(F.array_compact(F.array(
        F.when(F.col("neg_pos") == 0, F.struct(F.lit("pos").alias("side"),
                                               F.col("pos_dist").alias("d"))),
        F.struct(F.lit("neg").alias("side"), F.col("neg_dist").alias("d"))))).alias("s")
    ).select(model, "s.*")
    medians = (value_counts(sides, "d", [model, "side"])
               .groupBy(model)
               .agg(F.percentile(F.when(F.col("side") == "pos", F.col("d")), 0.5, F.col("n"))
                    .alias("median_pos"),
                    F.percentile(F.when(F.col("side") == "neg", F.col("d")), 0.5, F.col("n"))
                    .alias("median_neg")))
    means = sides.groupBy(model).agg(
        F.avg(F.when(F.col("side") == "pos", F.col("d"))).alias("avg_pos"),
        F.avg(F.when(F.col("side") == "neg", F.col("d"))).alias("avg_neg"))
    report = means.join(medians, model).withColumn("margin", F.col("avg_neg") - F.col("avg_pos"))
    # One row per model.
    return report.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("margin"), model)))


def item_similarity(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Per item: mean, smallest and largest cosine of the positive to its negatives."""
    sim = cosine_similarity("positive", "negative")
    return (df.select(id_col, sim.alias("s")).groupBy(id_col)
            .agg(F.avg("s").alias("mean_sim"), F.min("s").alias("min_sim"),
                 F.max("s").alias("max_sim")))
