"""Registered queries of this package, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripletspark.llm.audit import filter_audit
from tripletspark.llm.chat import format_turns, planted, read_back
from tripletspark.llm.decontaminate import contaminated
from tripletspark.llm.lines import line_classes
from tripletspark.llm.oracle import ORACLE
from tripletspark.llm.packing import pack
from tripletspark.llm.pii import pii_report
from tripletspark.llm.quality import quality_rules
from tripletspark.llm.secrets import scan_secrets
from tripletspark.llm.simhash import near_duplicates
from tripletspark.llm.spelling import spelling_variants
from tripletspark.llm.tables import read
from tripletspark.llm.token_files import token_files
from tripletspark.llm.toxicity import toxicity
from tripletspark.llm.urls import RULES, judge_urls

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document."""
    return pii_report(read(spark, sf, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality_rules(read(spark, sf, "documents"))


@query
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(read(spark, sf, "documents"))


@query
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf, "documents")).select(
        "doc_id", "fingerprint", "component_id")


@query
def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document."""
    return scan_secrets(read(spark, sf, "documents"))


@query
def op2_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations formatted, then read back from their ids and masks."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(planted(spark)))).drop("n_tokens")


@query
def op3_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page's address."""
    return judge_urls(read(spark, sf, "pages"), RULES)


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Class, links and fate of every line of every document."""
    return line_classes(read(spark, sf, "documents")).drop("digest")


@query
def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Five filters in all orders, by language."""
    return filter_audit(spark, f"{sf}/documents.parquet", read(spark, sf, "labels"))


@query
def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_files(read(spark, sf, "documents"))


@query
def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents with their more frequent spellings."""
    return spelling_variants(read(spark, sf, "documents"), spoil=199)
