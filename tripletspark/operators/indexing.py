"""Ranks and running totals without a one-task window over the table.

Rows are put into buckets whose number is bounded, bucket sizes are summed up into start
positions, and the exact rank inside a bucket is added. Every value is a function of the
row and the table, never of a partition number, so a recomputed task gives the same ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.session import cut_lineage

HASH_DIGITS = 4  # 65,536 buckets: the bound on every table of bucket sizes


def hash_key(id_col: Column | str, seed: int = 42) -> Column:
    """md5 of '<seed>:<id>': the pseudo-random order used for all sampling."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))


def count_of(df: DataFrame) -> Column:
    """Row count as a scalar subquery: no action on the driver."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _starts(sizes: DataFrame, group_cols: Sequence[str], bucket: str, value: str,
            out: str) -> DataFrame:
    before = (Window.partitionBy(*group_cols).orderBy(bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0).cast("long")))


def dense_index(df: DataFrame, id_col: str, *, seed: int = 42, group_cols: Sequence[str] = (),
                out: str = "idx") -> DataFrame:
    """0-based rank by hash order, in the table or in each group. ``id_col`` is unique.

    A group of any size is spread over the hash buckets, so no task sorts a whole group.
    """
    group_cols = list(group_cols)
    keyed = (df.withColumn("_h", hash_key(id_col, seed))
             .withColumn("_b", F.substring("_h", 1, HASH_DIGITS)))
    sizes = keyed.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(sizes, group_cols, "_b", "_n", "_start").drop("_n")
    if not group_cols:
        starts = F.broadcast(starts)  # at most 16**HASH_DIGITS rows
    local = F.row_number().over(
        Window.partitionBy(*group_cols, "_b").orderBy("_h", id_col))
    return (keyed.withColumn("_local", local)
            .join(starts, [*group_cols, "_b"])
            .withColumn(out, F.col("_start") + F.col("_local") - 1)
            .drop("_h", "_b", "_local", "_start"))


def running_total(df: DataFrame, key_cols: Sequence[str], value: str, out: str,
                  total: str | None = None) -> DataFrame:
    """Sum of ``value`` over all rows before this one, in md5 order of the unique key."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    keyed = (df.withColumn("_h", F.md5(name.cast("binary")))
             .withColumn("_b", F.substring("_h", 1, HASH_DIGITS)))
    sizes = keyed.groupBy("_b").agg(F.sum(value).alias("_v"))
    starts = _starts(sizes, [], "_b", "_v", "_start")
    if total:
        starts = starts.withColumn(total, F.sum("_v").over(Window.partitionBy()))
    inside = (Window.partitionBy("_b").orderBy("_h", *key_cols)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (keyed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(F.broadcast(starts.drop("_v")), "_b")
            .withColumn(out, (F.col("_start") + F.col("_local")).cast("long"))
            .drop("_h", "_b", "_local", "_start"))


def mark_sample(df: DataFrame, id_col: str, *, n: int | None = None,
                fraction: float | None = None, seed: int = 42,
                out: str = "in_sample") -> DataFrame:
    """Flag exactly min(n, N) rows (or ceil(fraction * N)): those first in hash order.

    The bucket sizes tell in which hash bucket the sample ends; only that bucket is ranked,
    to find the last row inside. All other rows compare their hash with it: the table itself
    is neither sorted nor shuffled.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    key = hash_key(id_col, seed)
    bucket = F.substring(key, 1, HASH_DIGITS)
    sizes = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    all_rows = F.sum("_n").over(Window.partitionBy())
    limit = F.lit(n) if n is not None else F.ceil(F.lit(fraction) * all_rows)
    last_bucket = (_starts(sizes, [], "_b", "_n", "_start")
                   .withColumn("_rank", F.least(limit, all_rows) - F.col("_start"))
                   .filter((F.col("_rank") > 0) & (F.col("_rank") <= F.col("_n")))
                   .select("_b", "_rank"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key, id_col))
    last_row = (df.select(id_col, bucket.alias("_b"))
                .join(F.broadcast(last_bucket), "_b")  # one row
                .withColumn("_place", place).filter(F.col("_place") == F.col("_rank"))
                .select(F.struct(key.alias("h"), F.col(id_col).alias("i"))))
    inside = F.struct(key.alias("h"), F.col(id_col).alias("i")) <= last_row.scalar()
    return df.withColumn(out, F.coalesce(inside, F.lit(False)))


ROWS_PER_CHUNK = 100_000
MAX_CHUNKS = 4096


def _as_number(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(col).cast("double")
    raise ValueError(f"{col} must be a number or a timestamp")


def order_chunks(df: DataFrame, order_col: str, chunks: int | None = None,
                 out: str = "_chunk") -> DataFrame:
    """Cut the value range of ``order_col`` into chunks of about equal row counts.

    The cut points come from one approximate-quantile aggregate (at most 4,095 numbers on
    the driver). They only balance the work; later ranks are exact for any cut points.
    """
    number = _as_number(df, order_col)
    # Rows without a value come first, as in a sort.
    single = F.when(number.isNull(), -1).otherwise(0).cast("long")
    if chunks is None:
        chunks = -(-df.count() // ROWS_PER_CHUNK)
    chunks = min(chunks, MAX_CHUNKS)
    if chunks < 2:
        return df.withColumn(out, single)
    shares = [i / chunks for i in range(1, chunks)]
    seen = df.agg(F.percentile_approx(number, shares, 10 * chunks).alias("q")).first().q
    points = sorted(set(seen or []))
    if not points:
        return df.withColumn(out, F.when(number.isNull(), -1).otherwise(0).cast("long"))
    splits = [float("-inf"), *points, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_number", outputCol="_cut", handleInvalid="keep")
    return (cut.transform(df.withColumn("_number", number))
            .withColumn(out, F.when(F.col("_number").isNull(), -1)
                        .otherwise(F.col("_cut")).cast("long")).drop("_number", "_cut"))


def ordered_index(df: DataFrame, order_col: str, tie_cols: Sequence[str] = (), *,
                  group_cols: Sequence[str] = (), out: str = "step_no") -> DataFrame:
    """0-based rank by ``order_col`` (ties by ``tie_cols``), in the table or per group.

    Expects ``_chunk`` from ``order_chunks``; a long group is ranked chunk by chunk.
    """
    group_cols = list(group_cols)
    sizes = df.groupBy(*group_cols, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(sizes, group_cols, "_chunk", "_n", "_start").drop("_n")
    if not group_cols:
        starts = F.broadcast(starts)  # at most MAX_CHUNKS rows
    local = F.row_number().over(
        Window.partitionBy(*group_cols, "_chunk").orderBy(order_col, *tie_cols))
    return (df.withColumn("_local", local)
            .join(starts, [*group_cols, "_chunk"])
            .withColumn(out, F.col("_start") + F.col("_local") - 1)
            .drop("_local", "_start"))


_LOCAL_BITS = 33  # row number inside a partition, in monotonically_increasing_id


def global_rank(df: DataFrame, order_cols: Sequence[str], chunks: int | None = None,
                out: str = "rank") -> DataFrame:
    """0-based rank by ``order_cols``, ascending with nulls first, for keys of any orderable type:
    text, binary, numbers, dates, structs.

    Spark's range shuffle samples the keys and cuts them into chunks; the rank is the number of
    rows in the chunks before plus the place in the sorted chunk. All ``order_cols`` take part in
    the cuts, so a first column with one value (or null) in a third of the rows is still cut by
    the next ones. The chunks are stored before they are counted, as a second run of the sample
    need not cut at the same keys. Rows that are equal in all columns get ranks in any order.
    """
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    if chunks is None:
        chunks = -(-df.count() // ROWS_PER_CHUNK)
    chunks = min(max(1, chunks), MAX_CHUNKS)
    placed = cut_lineage(df.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    chunk = F.shiftright("_at", _LOCAL_BITS)
    sizes = placed.groupBy(chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(sizes, [], "_chunk", "_n", "_start").drop("_n")
    return (placed.withColumn("_chunk", chunk).join(F.broadcast(starts), "_chunk")
            .withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1))
            .drop("_at", "_chunk", "_start"))


def assign_batches(df: DataFrame, size: int, order_col: str, chunks: int | None = None,
                   out: str = "batch", tie_cols: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of ``size`` rows in the order of ``order_col``, of any orderable type;
    give ``tie_cols`` where its values repeat."""
    if size < 1:
        raise ValueError("size must be at least 1")
    ranked = global_rank(df, [order_col, *tie_cols], chunks, "_pos")
    return (ranked.withColumn(out, F.floor(F.col("_pos") / size).cast("long")).drop("_pos"))
