"""Scans of source trees, parquet and JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.functions.text import C_HEADER, is_blank, parse_path, split_header
from tripletspark.operators.quality import drop_blank, reject_unparsed

CORRUPT = "_corrupt_record"


def scan_source_files(spark: SparkSession, path: str, glob: str = "*.c", *,
                      fail_if_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files (path, content), skipped (path)): recursive, by suffix, UTF-8 only, line
    ends normalised to ``\\n``. Raises when no file matches."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(path))
    if fail_if_empty and raw.select("path").limit(1).isEmpty():
        raise FileNotFoundError(f"no file matches {glob} under {path}")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    return (raw.filter(good).select("path", text.alias("content")),
            raw.filter(~good).select("path"))


def ingest(files: DataFrame, root: str, path: str = "path", content: str = "content",
           pattern: str = C_HEADER) -> DataFrame:
    """Collection rows from scanned files: ids, author pseudonym, header, code and the
    fields of the path. Blank code and unparsed paths are dropped."""
    from tripletspark.functions.text import assign_id, pseudonymize
    header, body = split_header(content, pattern)
    file_name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    rows = (files.withColumn("_p", parse_path(path, root)).select(
        assign_id(path, content).alias("code_id"), F.col("_p.author").alias("author_raw"),
        F.col("_p.cohort").alias("cohort"), F.col("_p.site").alias("site"),
        file_name.alias("exercise"), header.alias("header"), body.alias("code_snippet")))
    kept = drop_blank(reject_unparsed(rows, ["author_raw"]), ["code_snippet"])
    return kept.withColumn("author_id", pseudonymize("author_raw")).drop("author_raw")


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None
                 ) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str,
               mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a JSON-lines file with a declared schema.

    ``strict``: a blank or malformed line fails the query. ``skip_blank``: blank lines are
    skipped, malformed ones fail. ``skip_bad``: blank lines are skipped, malformed ones go
    to the rejected side.
    """
    if mode not in ("strict", "skip_blank", "skip_bad"):
        raise ValueError(f"unknown mode {mode!r}")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = spark.read.text(path)
    blank = is_blank("value")
    if mode != "strict":
        lines = lines.filter(~blank)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # Exploded, so that the tests below do not parse each line again.
    parsed = lines.select("value", F.explode(F.array(F.from_json("value", wide, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))).alias("_r"))
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull() | blank
    rejected = parsed.filter(bad).select("value")
    if mode == "skip_bad":
        parsed = parsed.filter(~bad)
    else:
        # A filter, because a column that nobody reads would never raise.
        parsed = parsed.filter(F.when(bad, F.raise_error(
            F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))
            .cast("boolean")).otherwise(F.lit(True)))
    return parsed.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema]), rejected


def scan_done(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys an output file of JSON lines already holds; blank, malformed and keyless lines
    do not count. None when there is no output yet."""
    try:
        good, _ = scan_jsonl(spark, path, f"{key} string", "skip_bad")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return good.filter(F.col(key).isNotNull()).select(key)
