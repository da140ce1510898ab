"""Embedding cache: Parquet by model and digest bucket, keyed by sha2(text).

The key holds the text, so an edited text or another model can never return a stale vector. The
bucket is the front of the digest: a look-up opens only the buckets that its texts fall into, and
beyond that Spark's own Bloom filter thins out the rows that a shuffled join would move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletspark.operators.quality import text_digest
from tripletspark.session import cut_lineage, scratch_path, stored

SCHEMA = "text_key binary, embedding array<float>, model string, bucket int"
BUCKETS = 4096


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        """``buckets``: a power of 16, at most 65,536; as long as the cache lives the same."""
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.conv(F.hex(F.substring("text_key", 1, 4)), 16, 10).cast("long"),
                      F.lit(self.buckets)).cast("int")

    def _stored(self, model: str, keys: DataFrame) -> DataFrame:
        """The stored rows of ``keys`` (text_key), each once, from the buckets they can be in."""
        table = stored(self.spark, self.path, SCHEMA)
        if table is None:
            table = self.spark.createDataFrame([], SCHEMA)
        # At most ``buckets`` numbers reach the driver.
        asked = [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        return (table.filter((F.col("model") == model) & F.col("bucket").isin(asked))
                .join(keys, "text_key", "left_semi").select("text_key", "embedding")
                .dropDuplicates(["text_key"]))

    def get(self, df: DataFrame, text_col: str, model: str) -> tuple[DataFrame, DataFrame]:
        """(rows with their stored embedding, rows not stored)."""
        keyed = df.withColumn("text_key", text_digest(text_col))
        found = self._stored(model, cut_lineage(keyed.select("text_key").distinct()))
        found = found.withColumn("_hit", F.lit(True))
        both = keyed.join(found, "text_key", "left").drop("text_key")
        return (both.filter("_hit").drop("_hit"),
                both.filter("_hit IS NULL").drop("_hit", "embedding"))

    def put(self, encoded: DataFrame, text_col: str, model: str) -> None:
        """Store vectors of texts that are not stored yet; storing twice changes nothing. The
        files appear when the whole job has succeeded; where two jobs store one text at a time,
        a look-up takes one of the two."""
        fresh = cut_lineage(
            encoded.select(text_digest(text_col).alias("text_key"),
                           F.col("embedding").cast("array<float>").alias("embedding"))
            .dropDuplicates(["text_key"]))
        known = self._stored(model, fresh.select("text_key"))
        (fresh.join(known, "text_key", "left_anti")
         .withColumn("model", F.lit(model)).withColumn("bucket", self._bucket())
         .repartition("bucket").sortWithinPartitions("bucket", "text_key")
         .write.mode("append").partitionBy("model", "bucket").parquet(self.path))

    def get_or_encode(self, df: DataFrame, text_col: str, model: str,
                      encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Embeddings for all rows; only distinct texts that are not stored are encoded."""
        _, missing = self.get(df, text_col, model)
        texts = (missing.withColumn("_k", text_digest(text_col)).groupBy("_k")
                 .agg(F.first(text_col).alias(text_col)).drop("_k"))
        self.put(encode(texts), text_col, model)
        known, _ = self.get(df, text_col, model)
        return known

    def clear(self, model: str | None = None) -> None:
        """Forget one model, or everything: the table is overwritten without it."""
        table = stored(self.spark, self.path, SCHEMA)
        if table is None:
            return
        kept = table.limit(0) if model is None else table.filter(F.col("model") != model)
        aside = scratch_path(self.spark, "cache-clear")
        kept.write.parquet(aside)
        (self.spark.read.schema(SCHEMA).parquet(aside)
         .write.mode("overwrite").partitionBy("model", "bucket").parquet(self.path))
