"""How filters interact, counted over a stream of files with retractions.

Files are read as available-now micro-batches. A filter on single texts gives a bit of a
document's mask at once. Whether an equal text with a smaller doc_id exists is not known before
the last file, so a table keyed by the text's digest holds the smallest doc_id met so far: a new
document that isn't the smallest fails for good; where a smaller one arrives, the counter of the
earlier one's mask is reduced (retracted) and that of its mask with the bit set is raised.

A micro-batch stores its documents in narrow form (no texts), the state rows that it adds and the
changes of the counters, each under its batch number. A batch that is repeated overwrites its own
folders and reads only earlier ones, so every document counts once. Copies are counted up before
they meet, and state and documents meet by (text, doc_id), so a text that makes up a third of all
rows isn't one task's work. All that follows the stream works on at most 32 masks a part.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletspark.llm.tables import fixed, words
from tripletspark.session import scratch_path

#: Micro-batches that the files are dealt to.
ROUNDS = 4
#: The filter for repeated texts; the others look at one text.
REPEATED = "E"
STATE = ("key binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long")
CHANGES = "part string, mask int, n long, n_good long, n_toxic long"


def failures(text: Column, ws: Column) -> dict[str, Column]:
    """What fails: A few words, B few different words, C capitals, D symbols."""
    n, chars = F.size(ws).cast("long"), F.char_length(text).cast("long")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 100, "B": 100 * F.size(F.array_distinct(ws)) < 80 * n,
            "C": 100 * capitals > 10 * chars, "D": text.rlike(r"[#$%&*|]")}


def _bit(name: str, names: str) -> int:
    return 1 << names.index(name)


def narrow(docs: DataFrame, names: str) -> DataFrame:
    """key (digest of the text), doc_id, part, mask without the bit for repeated texts, and n:
    how many rows are equal in all these."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
                     words(text).alias("ws"))
    # The words are split once, behind a generator, not again for each filter.
    df = fixed(df, ["doc_id", "part"], text=F.col("text"), ws=F.col("ws"))
    mask = F.lit(0)
    for name, fails in failures(F.col("text"), F.col("ws")).items():
        mask = mask + F.when(fails, _bit(name, names)).otherwise(0)
    return (df.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "doc_id",
                      "part", mask.cast("int").alias("mask"))
            .groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n")))


def _flags(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))


def _change(rows: DataFrame, mask: Column, sign: int = 1) -> DataFrame:
    n = sign * F.col("n")
    return rows.select("part", mask.cast("int").alias("mask"), n.alias("n"),
                       F.when(F.col("good"), n).otherwise(0).alias("n_good"),
                       F.when(F.col("toxic"), n).otherwise(0).alias("n_toxic"))


def mask_counters(spark: SparkSession, path: str, labels: DataFrame, names: str = "ABCDE",
                  rounds: int = ROUNDS, work: str | None = None) -> DataFrame:
    """part, mask, n, n_good, n_toxic over the documents in ``path`` (Parquet). ``work``: the
    folder of state, counters and progress; a run that broke off goes on there, and files that
    have come since are added."""
    work = work or scratch_path(spark, "audit")
    schema = spark.read.parquet(path).schema
    files = len(spark.read.parquet(path).inputFiles())
    again = _bit(REPEATED, names)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows_at, state_at, changes_at = (f"{work}/{x}/{number}"
                                         for x in ("rows", "state", "changes"))
        flags = _flags(labels)
        (narrow(batch, names).join(flags, "doc_id", "left")
         .select("key", "doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
                 F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
         .write.mode("overwrite").parquet(rows_at))
        rows = session.read.schema(STATE).parquet(rows_at)
        known = rows.where(F.col("doc_id").isNotNull())
        least = known.groupBy("key").agg(F.min("doc_id").alias("least"))
        if number:
            earlier = session.read.schema(STATE).parquet(
                *[f"{work}/state/{k}" for k in range(number)])
        else:
            earlier = session.createDataFrame([], STATE)
        before = earlier.groupBy("key").agg(F.min("doc_id").alias("before"))
        moves = least.join(before, "key", "left").where(
            F.col("before").isNull() | (F.col("least") <= F.col("before")))
        first = moves.select("key", F.col("least").alias("doc_id"))
        known.join(first, ["key", "doc_id"]).select(*known.columns).write.mode(
            "overwrite").parquet(state_at)
        new = session.read.schema(STATE).parquet(state_at)
        passed = moves.where(F.col("least") < F.col("before")).select(
            "key", F.col("before").alias("doc_id"))
        old = earlier.join(passed, ["key", "doc_id"]).select(*known.columns)
        mask, marked = F.col("mask"), F.col("mask") + again
        total = _change(rows, F.when(F.col("doc_id").isNull(), mask).otherwise(marked))
        for more in (_change(new, mask), _change(new, marked, -1),
                     _change(old, marked), _change(old, mask, -1)):
            total = total.unionByName(more)
        (total.groupBy("part", "mask")
         .agg(*[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])
         .write.mode("overwrite").parquet(changes_at))

    # As a pattern, since a stream takes a single file (not a folder) in no other way.
    pattern = path.rstrip("/")
    pattern = f"{pattern[:-1]}[{pattern[-1]}]"
    (spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // rounds)))
     .parquet(pattern).writeStream.foreachBatch(step)
     .option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start()
     .awaitTermination())
    if not files:
        return spark.createDataFrame([], CHANGES)
    return (spark.read.schema(CHANGES).parquet(f"{work}/changes/*").groupBy("part", "mask")
            .agg(*[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])
            .where(F.col("n") != 0))


def interactions(counters: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, zeros included, from the mask counters."""
    orders = F.lit(["".join(p) for p in itertools.permutations(names)])
    steps = counters.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    bit = F.lit(0)
    before = F.lit(0)
    for name in names:
        place = F.instr("filter_order", name)
        bit = bit + F.when(place == F.col("step"), _bit(name, names)).otherwise(0)
        before = before + F.when(place < F.col("step"), _bit(name, names)).otherwise(0)
    fails = F.col("mask").bitwiseAND(bit) != 0
    earlier = F.col("mask").bitwiseAND(before) != 0
    removed = fails & ~earlier

    def total(when: Column, value: str, name: str) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0)).alias(name)

    table = steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, "n", "kept"), total(removed, "n", "removed"),
        total(fails & earlier, "n", "redundant"),
        total(F.col("mask") == bit, "n", "unique_fails"),
        total(removed, "n_good", "good_lost"), total(removed, "n_toxic", "toxic_lost"))
    table = table.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    shares = table.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return table.join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")


def filter_audit(spark: SparkSession, path: str, labels: DataFrame,
                 options: Mapping | None = None) -> DataFrame:
    """How five filters interact on the documents in ``path``, by part (``lang``).

    Null texts are empty, a null lang is the part ''. A text fails for being repeated where a
    document of smaller doc_id has the same text; a null doc_id is neither smaller nor larger.
    Repeated rows count as often as they occur and don't fail by each other. Long texts are read
    whole; other columns stay out. Several labels of one doc_id: any that says so counts. No
    documents: no rows.
    """
    return interactions(mask_counters(spark, path, labels, **(options or {})))
