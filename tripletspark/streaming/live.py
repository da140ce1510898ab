"""Live view of training metrics: windows, their store, and the newest state of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_monitor(stream: DataFrame, ts: str, value: str, *, width: str = "1 hour",
                 slide: str | None = None, lateness: str = "10 minutes",
                 group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Mean, min, max and count per event-time window. Works on a stream and on a table;
    on a stream, rows later than ``lateness`` behind the newest are dropped."""
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (timed.groupBy(frame.alias("w"), *group_cols)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                 F.min(value).alias("min"), F.max(value).alias("max"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group_cols,
                    "n", "mean", "min", "max"))


def store_windows(windows: DataFrame, out: str, progress: str) -> None:
    """Take in what has arrived. Each batch stores the windows that it changed under its own
    number, so a repeated batch replaces itself; windows that are still open are there too."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    (windows.writeStream.outputMode("update").option("checkpointLocation", progress)
     .trigger(availableNow=True).foreachBatch(save).start().awaitTermination())


def stored_windows(spark: SparkSession, out: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Every window as its last batch left it, open ones included."""
    keys = ["start", "end", *group_cols]
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_x"))
            .select(*keys, *[f"_x.{c}" for c in values]))
