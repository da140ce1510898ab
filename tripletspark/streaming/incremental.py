"""Resumable processing of a growing folder.

Beside the output stands a state folder: the keys that are done, narrow and in hash buckets, and the
batches that failed. A micro-batch looks for its keys in the buckets that it touches and never reads
the output. Output and keys of a batch lie in folders named after the run and the batch, which a
repeated batch overwrites, so neither a crash between the two writes nor a replay adds anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.operators.quality import remaining
from tripletspark.session import stored

BUCKETS = 64
#: The column that names a row's run and batch in the stored output.
PART = "run_batch"


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class _State:
    """The keys that are done and the batches that failed."""

    def __init__(self, spark: SparkSession, out: str, folder: str, key: str):
        self.spark, self.out, self.folder, self.key = spark, out, folder, key

    def todo(self, rows: DataFrame, part: str) -> DataFrame:
        """One row of each key that no other batch has done; rows without a key always count."""
        rows = rows.dropDuplicates([self.key])
        done = stored(self.spark, f"{self.folder}/keys", T.StructType([
            rows.schema[self.key], T.StructField("bucket", T.IntegerType()),
            T.StructField(PART, T.StringType())]))
        if done is None:
            return rows
        touched = [r.b for r in rows.select(_bucket(self.key).alias("b")).distinct().collect()]
        done = done.filter(F.col("bucket").isin(touched) & (F.col(PART) != part))
        return remaining(rows, done, self.key)

    def finish(self, rows: DataFrame, part: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Process rows and note their keys, as one part that a replay overwrites."""
        todo = self.todo(rows, part)
        fn(todo).write.mode("overwrite").parquet(f"{self.out}/{PART}={part}")
        written = self.spark.read.parquet(f"{self.out}/{PART}={part}")
        keys = (written if self.key in written.columns else todo).select(self.key)
        (keys.filter(F.col(self.key).isNotNull()).distinct()
         .withColumn("bucket", _bucket(self.key)).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/keys/{PART}={part}"))

    def bury(self, rows: DataFrame, part: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/failed/{PART}={part}")

    def open_parts(self) -> list[str]:
        """Failed batches that have not been done since; one name a batch."""
        failed = stored(self.spark, f"{self.folder}/failed", f"{PART} string")
        if failed is None:
            return []
        names = failed.select(PART).distinct()
        drained = stored(self.spark, f"{self.folder}/drained", f"{PART} string")
        if drained is not None:
            names = names.join(drained, PART, "left_anti")
        return sorted(r[PART] for r in names.collect())

    def drain(self, fn: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Process failed batches again; those that fail once more stay for the next run."""
        errors = []
        for part in self.open_parts():
            rows = self.spark.read.parquet(f"{self.folder}/failed/{PART}={part}")
            try:
                self.finish(rows, f"again-{part}", fn)
            except Exception as e:
                errors.append(f"batch {part}: {e}")
                continue
            self.spark.createDataFrame([(part,)], f"{PART} string").coalesce(1).write.mode(
                "append").parquet(f"{self.folder}/drained")
        return errors


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint, as the numbers of its batches do."""
    path = f"{checkpoint}/run-name"
    known = stored(spark, path, "name string")
    if known is None:
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "name string").coalesce(1).write.mode(
            "overwrite").parquet(path)
        known = spark.read.parquet(path)
    return known.first().name


def incremental_process(spark: SparkSession, source: str, out: str, checkpoint: str, key: str,
                        fn: Callable[[DataFrame], DataFrame], schema: T.StructType, *,
                        glob: str | None = None, files_per_batch: int | None = None,
                        skip_failed: bool = False, state: str | None = None) -> list[str]:
    """Process what is new in ``source`` and add the results to ``out`` (read it with
    ``processed``). Keys that are done are left out, also after the progress was lost.

    An error in ``fn`` ends the run, and the next one starts at that batch. With ``skip_failed``
    the batch goes to the dead letters in ``state`` (by default beside ``out``) and the run goes
    on; every run first takes up the dead letters of the earlier ones. The errors of batches
    that are still open are returned.
    """
    kept = _State(spark, out, state or f"{out.rstrip('/')}-state", key)
    errors = kept.drain(fn)
    run = _run_name(spark, checkpoint)
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"{run}-{batch_id:06d}"
        own = _State(batch.sparkSession, out, kept.folder, key)
        try:
            own.finish(batch, part, fn)
        except Exception as e:
            if not skip_failed:
                raise
            own.bury(batch, part)
            errors.append(f"batch {batch_id}: {e}")

    query = (reader.parquet(source).writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return errors


def processed(spark: SparkSession, out: str) -> DataFrame:
    """The results so far."""
    return spark.read.parquet(out).drop(PART)


def retry_open(spark: SparkSession, source: DataFrame, out: str, key: str,
               fn: Callable[[DataFrame], DataFrame], state: str | None = None) -> None:
    """Process the rows of ``source`` that are not done, as a part of its own."""
    kept = _State(spark, out, state or f"{out.rstrip('/')}-state", key)
    kept.finish(source, f"open-{uuid.uuid4().hex[:12]}", fn)
