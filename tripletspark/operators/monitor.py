"""Training-run windows over step metrics (run, step order, loss, ...).

A single run may be a large part of the table, so no window spans a whole run: runs are cut
into chunks along the step order, values cross chunk borders through one small table per
(run, chunk), or through copies of the few border rows a frame needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.operators.indexing import order_chunks, ordered_index

SEGMENT = 10_000


def with_steps(df: DataFrame, run: str, order_col: str, tie_cols: Sequence[str] = (),
               chunks: int | None = None) -> DataFrame:
    """Add ``step_no`` (0-based per run) and ``_chunk``."""
    return ordered_index(order_chunks(df, order_col, chunks), order_col, tie_cols,
                         group_cols=[run], out="step_no")


def _segments(steps: DataFrame, back: int, segment: int) -> DataFrame:
    """Cut runs into segments of ``segment`` steps; each also gets the ``back`` steps
    before it, flagged ``_context``."""
    size = max(segment, back, 1)
    own = F.floor(F.col("step_no") / size)
    last = F.col("step_no") % size >= size - back
    copies = F.array_compact(F.array(
        F.struct(own.alias("s"), F.lit(False).alias("c")),
        F.when(last & F.lit(back > 0), F.struct((own + 1).alias("s"), F.lit(True).alias("c")))))
    return (steps.withColumn("_k", F.explode(copies))
            .withColumn("_segment", F.col("_k.s")).withColumn("_context", F.col("_k.c"))
            .drop("_k"))


def rolling_window(df: DataFrame, run: str, order_col: str, value: str, n: int = 100,
                   tie_cols: Sequence[str] = (), *, chunks: int | None = None,
                   segment: int = SEGMENT) -> DataFrame:
    """Mean, min and max of the last n values of each run (the row itself included)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    parts = _segments(with_steps(df, run, order_col, tie_cols, chunks), n - 1, segment)
    frame = (Window.partitionBy(run, "_segment").orderBy("step_no")
             .rowsBetween(-(n - 1), 0))
    return (parts.withColumn("rolling_mean", F.avg(value).over(frame))
            .withColumn("rolling_min", F.min(value).over(frame))
            .withColumn("rolling_max", F.max(value).over(frame))
            .filter(~F.col("_context")).drop("_context", "_segment", "_chunk"))


def step_rate(df: DataFrame, run: str, seconds: Column, order_col: str,
              tie_cols: Sequence[str] = (), *, chunks: int | None = None,
              segment: int = SEGMENT) -> DataFrame:
    """Steps per second: 1 / (elapsed since the previous step + 1e-8); null on the first."""
    steps = with_steps(df.withColumn("_sec", seconds), run, order_col, tie_cols, chunks)
    parts = _segments(steps, 1, segment)
    before = F.lag("_sec").over(Window.partitionBy(run, "_segment").orderBy("step_no"))
    return (parts.withColumn("steps_per_sec", 1.0 / (F.col("_sec") - before + 1e-8))
            .filter(~F.col("_context")).drop("_context", "_segment", "_chunk", "_sec"))


def training_summary(df: DataFrame, run: str, order: Column, seconds: Column, *,
                     loss: str = "loss", separation: str = "separation",
                     violations: str = "violations_pct", margin: float = 0.5) -> DataFrame:
    """First, last and best values per run, loss reduction, elapsed time, health flags.

    Only mergeable aggregates: a long run is combined on the map side.
    """
    first, last = F.min_by(loss, order), F.max_by(loss, order)
    last_sep, last_viol = F.max_by(separation, order), F.max_by(violations, order)
    return df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"),
        first.alias("first_loss"), last.alias("last_loss"), F.min(loss).alias("best_loss"),
        F.max(separation).alias("best_separation"), F.min(violations).alias("best_violations"),
        F.try_divide(100.0 * (first - last), first).alias("loss_reduction_pct"),
        (F.max(seconds) - F.min(seconds)).alias("elapsed_sec"),
        (last < first).alias("loss_fell"), (last_sep > margin).alias("separated"),
        (last_viol < 20).alias("few_violations"))


def _carried(steps: DataFrame, run: str, agg: Column, combine, out: str) -> DataFrame:
    """Per (run, chunk): an aggregate over all earlier chunks of the run."""
    earlier = (Window.partitionBy(run).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (steps.groupBy(run, "_chunk").agg(agg.alias("_x"))
            .withColumn(out, combine("_x").over(earlier)).drop("_x"))


def early_stopping(df: DataFrame, run: str, order_col: str, loss: str = "loss",
                   patience: int = 5, tie_cols: Sequence[str] = (), *,
                   chunks: int | None = None) -> DataFrame:
    """Per run (steps from 1): best_step, best_loss and stop_step. A step is best when its
    loss is strictly below all earlier ones; the run stops at the first step with
    ``patience`` steps since the best one. Later steps do not count."""
    if patience < 1:
        raise ValueError("patience must be at least 1")
    steps = with_steps(df, run, order_col, tie_cols, chunks)
    inside = Window.partitionBy(run, "_chunk").orderBy("step_no")
    keys = [run, "_chunk"]
    steps = steps.join(_carried(steps, run, F.min(loss), F.min, "_min_before"), keys)
    before = F.least(F.col("_min_before"),
                     F.min(loss).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    steps = steps.withColumn("_lowest", before)
    better = F.col("_lowest").isNull() | (F.col(loss) < F.col("_lowest"))
    steps = steps.withColumn("_best_at", F.when(better, F.col("step_no")))
    steps = steps.join(_carried(steps, run, F.max("_best_at"), F.max, "_at_before"), keys)
    best_at = F.greatest(F.col("_at_before"), F.max("_best_at").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    waited = steps.withColumn("_wait", F.col("step_no") - best_at)
    over = F.col("_wait") >= patience
    ended = waited.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.min(F.when(over, F.col("step_no"))).alias("_stop"),
        F.min_by(F.when(over, F.col("_lowest")), F.when(over, F.col("step_no"))).alias("_low"),
        F.max("_best_at").alias("_last_best"), F.min(loss).alias("_min"))
    stopped = F.col("_stop").isNotNull()
    return ended.select(
        run, "n_steps",
        F.when(stopped, F.col("_stop") - patience).otherwise(F.col("_last_best"))
        .alias("_b"),
        F.when(stopped, F.col("_low")).otherwise(F.col("_min")).alias("best_loss"),
        (F.col("_stop") + 1).alias("stop_step"), stopped.alias("stopped")
    ).withColumn("best_step", F.col("_b") + 1).drop("_b")
