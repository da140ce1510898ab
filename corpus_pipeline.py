"""Cleaning pipeline over documents: each stage's rows are written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripletspark.llm.decontaminate import drop_contaminated
from tripletspark.llm.jaccard import drop_similar
from tripletspark.llm.lines import drop_repeated_lines
from tripletspark.llm.packing import pack
from tripletspark.llm.quality import apply_quality
from tripletspark.llm.tables import read
from tripletspark.session import scratch_path

#: Tokenizers, edit joins and alignments are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail or run dry go, lines too frequent in a source too."""
    return apply_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each class of lines the first stays; documents that are copies go."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of documents joined by a Jaccard similarity of 0.8 or more over five-word
    shingles one stays."""
    return drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: what is left as pieces of sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("benchmark", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
