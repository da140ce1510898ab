"""Sinks: parquet, JSON lines, run log and metric reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.operators.metrics import metrics_json


def sink_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sink_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append a batch. The commit is one per job, so readers never see half a batch."""
    try:
        df.write.mode("append").option("ignoreNullFields", False).json(path)
    except Exception as e:
        raise OSError(f"cannot append to {path}: {e}") from e


def parquet_to_jsonl(spark: SparkSession, source: str, target: str) -> None:
    sink_jsonl(spark.read.parquet(source), target)


# The columns of the run log.
RUN_LOG_COLUMNS = (
    "timestamp", "run_id", "llm_model", "base_embedding_model", "training_mode",
    "num_epochs", "batch_size", "learning_rate", "warmup_ratio", "triplet_margin",
    "evaluator_type", "metric_for_best_model", "negative_mining_enabled",
    "negative_mining_strategy", "negative_mining_model", "min_similarity",
    "max_similarity", "final_test_loss", "final_metric_value", "model_output_path",
    "dataset_path", "notes",
)
RUN_LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RUN_LOG_COLUMNS])


def log_run(spark: SparkSession, path: str, values: Mapping[str, object],
            now: datetime | None = None) -> None:
    """Append one run to the log table; what is missing stays null."""
    unknown = set(values) - set(RUN_LOG_COLUMNS)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    stamp = (now or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    row = {"timestamp": stamp, **values}
    data = [tuple(None if row.get(c) is None else str(row[c]) for c in RUN_LOG_COLUMNS)]
    spark.createDataFrame(data, RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path)


def run_log_csv(log: DataFrame, path: str) -> None:
    """The log as CSV with 'N/A' where a value is missing."""
    filled = log.select(*[F.coalesce(F.col(c), F.lit("N/A")).alias(c) for c in log.columns])
    filled.write.mode("overwrite").option("header", True).csv(path)


def sink_metrics(long: DataFrame, path: str) -> None:
    """Rows (metric, k, value) as one nested JSON report."""
    metrics_json(long).coalesce(1).write.mode("overwrite").text(path)
