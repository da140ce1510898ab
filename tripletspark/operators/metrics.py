"""Statistics and classification metrics as grouped aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                 decimals: int = 6) -> DataFrame:
    """(groups, value, n) at fixed precision. Combined before the shuffle, and small even
    for a hot group, because cosines and distances have few values at six decimals."""
    return (df.groupBy(*group_cols, F.round(F.col(value).cast("double"), decimals).alias(value))
            .agg(F.count(F.lit(1)).alias("n")))


def weighted_stats(counts: DataFrame, value: str, weight: str,
                   group_cols: Sequence[str] = (), above: float = 0.5) -> DataFrame:
    """Statistics of a value that occurs ``weight`` times per row; exact, interpolated
    quantiles."""
    v, w = F.col(value), F.col(weight).cast("long")
    kept = counts.filter(v.isNotNull())
    n = F.sum(w)
    mean = F.sum(v * w) / n
    quantiles = F.percentile(v, [0.25, 0.5, 0.75], w)
    stats = kept.groupBy(*group_cols).agg(
        n.alias("n"), mean.alias("mean"), quantiles.alias("_q"),
        (F.sum(v * v * w) / n).alias("_m2"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        (100.0 * F.sum(F.when(v > above, w).otherwise(0)) / n).alias("pct_above"))
    return stats.select(
        *group_cols, F.coalesce("n", F.lit(0)).alias("n"), "mean",
        F.col("_q")[1].alias("median"),
        F.sqrt(F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0.0)))
        .alias("std"),
        "min", "max", F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), "pct_above")


def similarity_stats(df: DataFrame, sim: str, group_cols: Sequence[str] = (),
                     above: float = 0.5) -> DataFrame:
    """mean, median, population std, min, max, quartiles, percentage above a limit; the
    similarities are taken at six decimals."""
    return weighted_stats(value_counts(df, sim, group_cols), sim, "n", group_cols, above)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) for ``bins`` equal-width bins; the last one is closed. Empty bins
    are listed. When all values are equal the range is widened by 0.5 to each side."""
    x = F.col(col).cast("double")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.struct(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).alias("edges"))
    placed = (df.filter(x.isNotNull()).select(x.alias("x"))
              .withColumn("e", edges.scalar())
              .select(F.least(
                  F.floor((F.col("x") - F.col("e.lo")) * bins / (F.col("e.hi") - F.col("e.lo"))),
                  F.lit(bins - 1)).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    width = (F.col("edges.hi") - F.col("edges.lo")) / bins
    grid = (edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
            .filter(F.col("edges.lo").isNotNull())
            .select("bin", (F.col("edges.lo") + F.col("bin") * width).alias("lo"),
                    (F.col("edges.lo") + (F.col("bin") + 1) * width).alias("hi")))
    return (grid.join(placed, "bin", "left")
            .select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")))


def item_stats(df: DataFrame, code_col: str, feedback_col: str,
               negatives_col: str | None = None) -> DataFrame:
    """Per row: code length, feedback length and number of negatives."""
    n = F.size(F.coalesce(F.col(negatives_col), F.array().cast(
        df.schema[negatives_col].dataType))) if negatives_col else F.lit(0)
    return (df.withColumn("code_chars", F.coalesce(F.length(code_col), F.lit(0)))
            .withColumn("feedback_chars", F.coalesce(F.length(feedback_col), F.lit(0)))
            .withColumn("n_negatives", n))


def dataset_stats(df: DataFrame, code_col: str, negatives_col: str) -> DataFrame:
    """Examples, total and mean number of negatives, mean code length."""
    n = F.size(F.coalesce(F.col(negatives_col),
                          F.array().cast(df.schema[negatives_col].dataType)))
    return df.agg(F.count(F.lit(1)).alias("n_examples"),
                  F.coalesce(F.sum(n), F.lit(0)).alias("n_negatives"),
                  F.avg(n).alias("mean_negatives"),
                  F.avg(F.coalesce(F.length(code_col), F.lit(0))).alias("mean_code_chars"))


def corpus_stats(corpus: DataFrame, text_col: str, vectors: DataFrame, vec: str) -> DataFrame:
    """Documents, mean text length, number of vectors and their dimension."""
    texts = corpus.agg(F.count(F.lit(1)).alias("n_documents"),
                       F.avg(F.length(text_col)).alias("mean_chars"))
    sizes = vectors.agg(F.struct(F.count(vec).alias("n"), F.max(F.size(vec)).alias("d"))
                        .alias("s"))
    return (texts.withColumn("_s", sizes.scalar())
            .select("n_documents", "mean_chars", F.col("_s.n").alias("n_embeddings"),
                    F.col("_s.d").alias("dimension")))


def judgement_summary(df: DataFrame, verdicts: Mapping[str, str | Column]) -> DataFrame:
    """Per feedback type, over the rows that carry a verdict: count, mean score (a missing
    score counts 0), and count and percentage of each flag.

    ``verdicts`` maps the type's name to its verdict struct.
    """
    flags = {"factually_correct": "is_factually_correct",
             "conceptually_clear": "is_conceptually_clear",
             "applicable": "is_applicable",
             "needs_correction": "needs_correction"}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("feedback_type"),
                 (F.col(c) if isinstance(c, str) else c).alias("v"))
        for name, c in verdicts.items()])).alias("r")).select("r.*").filter("v IS NOT NULL")
    counts = [F.count_if(F.coalesce(F.col(f"v.{f}"), F.lit(False))).alias(f"n_{n}")
              for n, f in flags.items()]
    out = long.groupBy("feedback_type").agg(
        F.count(F.lit(1)).alias("n_judged"),
        F.avg(F.coalesce("v.quality_score", F.lit(0.0))).alias("mean_score"), *counts)
    for n in flags:
        out = out.withColumn(f"pct_{n}", 100.0 * F.col(f"n_{n}") / F.col("n_judged"))
    return out


def _weighted(condition: Column, weight: str | None) -> Column:
    """How many rows meet the condition, each counted ``weight`` times."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("long")


def threshold_metrics(df: DataFrame, distance: str, label: str,
                      thresholds: Sequence[float] = (0.5, 0.7, 0.8),
                      group_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Predict 1 iff distance < t (strict); accuracy, precision, recall and F1 per t.

    All thresholds are counted in one pass, rows are not multiplied. ``weight``: how often a row
    counts, as in a histogram.
    """
    if not thresholds:
        raise ValueError("give at least one threshold")
    d, positive = F.col(distance), F.col(label) == 1
    cells = []
    for i, t in enumerate(thresholds):
        cells += [_weighted((d < t) & positive, weight).alias(f"tp{i}"),
                  _weighted((d < t) & ~positive, weight).alias(f"fp{i}"),
                  _weighted(~(d < t) & positive, weight).alias(f"fn{i}"),
                  _weighted(~(d < t) & ~positive, weight).alias(f"tn{i}")]
    wide = df.groupBy(*group_cols).agg(*cells)
    long = wide.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn", "tn")])
        for i, t in enumerate(thresholds)])).alias("m")).select(*group_cols, "m.*")

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return long.select(
        *group_cols, "threshold", "tp", "fp", "fn", "tn",
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, distance: str, label: str,
            group_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve of score = 1 - distance, ties counted half; NaN when only
    one class occurs.

    ``weight``: how often a row counts. Rows are first counted per score (six decimals), scores then per chunk of a thousandth;
    running counts go inside chunks and over the few thousand chunks.
    """
    group_cols = list(group_cols)
    positive = F.col(label) == 1
    per_score = (df.groupBy(*group_cols, F.round(1.0 - F.col(distance), 6).alias("s"))
                 .agg(_weighted(positive, weight).alias("p"),
                      _weighted(~positive, weight).alias("q"))
                 .withColumn("c", F.floor(F.col("s") * 1000)))

    def below(order: str, value: str, *keys: str) -> Column:
        rows = (Window.partitionBy(*group_cols, *keys).orderBy(order)
                .rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.sum(value).over(rows), F.lit(0))

    per_chunk = (per_score.withColumn("w", F.col("p") * (below("s", "q", "c").cast("double") + F.col("q") * 0.5))
                 .groupBy(*group_cols, "c")
                 .agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q")))
    return (per_chunk.withColumn("w", F.col("w") + F.col("p") * below("c", "q").cast("double"))
            .groupBy(*group_cols)
            .agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("w").alias("w"))
            .select(*group_cols, F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
                    F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
                    F.coalesce(F.try_divide(F.col("w") / F.col("n_pos"), F.col("n_neg")),
                               F.lit(float("nan"))).alias("auc")))


def rank_models(df: DataFrame, by: str, model: str = "model",
                descending: bool = True) -> DataFrame:
    """Rank the models of a results table (one row per model), ties by name."""
    order = F.desc(by) if descending else F.asc(by)
    # One row per model: the window holds the models, never the data.
    return df.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(order, model)))


def model_spread(df: DataFrame, score: str, model: str = "model",
                 limit: float = 0.1) -> DataFrame:
    """Best and worst model by mean score, their range, and whether the choice matters."""
    return df.agg(
        F.max_by(model, score).alias("best_model"), F.max(score).alias("best_score"),
        F.min_by(model, score).alias("worst_model"), F.min(score).alias("worst_score"),
        (F.max(score) - F.min(score)).alias("score_range"),
        (F.max(score) - F.min(score) > limit).alias("choice_matters"))


def metrics_long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide row of metrics -> rows (metric, value)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in names])).alias("m")).select("m.*")


def metrics_json(long: DataFrame) -> DataFrame:
    """Rows (metric, k, value) -> one JSON report {metric: {k: value}} in ``report``."""
    per_metric = long.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.coalesce(F.col("k").cast("string"), F.lit("all")), "value")))).alias("m"))
    return per_metric.agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct("metric", "m")))).alias("report"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


