"""Seeded samples, exact splits and random partners. No cross join anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletspark.operators.indexing import count_of, dense_index, hash_key, mark_sample
from tripletspark.operators.quality import drop_legacy

TOP_N_ON_DRIVER = 10_000


def head(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First n rows by ``order_col``."""
    return df.orderBy(order_col).limit(n)


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, N) rows without replacement, the same at any partition count."""
    if n <= TOP_N_ON_DRIVER:
        return df.orderBy(hash_key(id_col, seed), id_col).limit(n)
    return mark_sample(df, id_col, n=n, seed=seed).filter("in_sample").drop("in_sample")


def train_val_split(df: DataFrame, id_col: str, test: float = 0.1,
                    seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) with exactly ceil(test * N) validation rows."""
    marked = mark_sample(df, id_col, fraction=test, seed=seed)
    return (marked.filter(~F.col("in_sample")).drop("in_sample"),
            marked.filter("in_sample").drop("in_sample"))


def hashed(modulus: Column, *parts: Column | int | str) -> Column:
    """A number below ``modulus`` from the md5 of ``parts`` (48 bits of it)."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string")
                              for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % modulus


def first_offset(idx: Column, n: Column, seed: int) -> Column:
    """Where row ``idx`` starts in its cyclic walk over the other n - 1 rows: anywhere, at any
    table size, since it is a hash of the row."""
    return hashed(F.greatest(n - 1, F.lit(1)), seed, "walk", idx)


def partner(idx: Column, n: Column, step: Column, seed: int) -> Column:
    """Index of the row met at ``step`` of the walk: never ``idx`` itself, and distinct for
    different steps below n - 1."""
    return (idx + 1 + (first_offset(idx, n, seed) + step) % F.greatest(n - 1, F.lit(1))) % n


def random_partners(ids: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """(id, pos, neg_id): min(k, N - 1) distinct other rows per row.

    The index is itself a hash order, so neighbours on the walk are unrelated rows. Work
    and shuffle are N * k narrow rows.
    """
    base = ids.select(id_col)
    indexed = dense_index(base, id_col, seed=seed)
    n = count_of(base)
    drawn = (indexed.withColumn("_N", n)
             .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
             .filter(F.col("pos") < F.col("_N") - 1)
             .withColumn("_to", partner(F.col("idx"), F.col("_N"), F.col("pos"), seed))
             .select(id_col, "pos", "_to"))
    targets = indexed.select(F.col("idx").alias("_to"), F.col(id_col).alias("neg_id"))
    return drawn.join(targets, "_to").select(id_col, "pos", "neg_id")


def random_negatives(df: DataFrame, id_col: str, text_col: str, k: int,
                     seed: int = 42, out: str = "negatives") -> DataFrame:
    """Attach the texts of k random other rows and drop the old single-negative columns.
    Texts travel once, last."""
    if k < 1:
        raise ValueError("k must be at least 1")
    pairs = random_partners(df, id_col, k, seed)
    texts = df.select(F.col(id_col).alias("neg_id"), F.col(text_col).alias("_text"))
    lists = (pairs.join(texts, "neg_id")
             .groupBy(id_col)
             .agg(F.array_sort(F.collect_list(F.struct("pos", "_text"))).alias("_l"))
             .select(id_col, F.transform("_l", lambda s: s["_text"]).alias(out)))
    return (drop_legacy(df.drop(out)).join(lists, id_col, "left")
            .withColumn(out, F.coalesce(out, F.array().cast("array<string>"))))
