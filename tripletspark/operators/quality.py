"""Validation, filtering, deduplication and merging of collections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.functions.text import clean_whitespace, is_blank
from tripletspark.session import broadcast_if_small, cut_lineage


# Columns of the old single-negative format.
LEGACY_COLUMNS = ("hard_negative_feedback", "hard_negative_similarity",
                  "hard_negative_source_id", "random_negative")


def drop_legacy(df: DataFrame) -> DataFrame:
    return df.drop(*LEGACY_COLUMNS)


def is_filled(df: DataFrame, name: str) -> Column:
    """True when the field is present and neither null, '', 0, False, [] nor {}."""
    if name not in df.columns:
        return F.lit(False)
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        test = c != ""
    elif isinstance(kind, T.NumericType):
        test = c != 0
    elif isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def missing_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    """Names of the required fields the row lacks, in the given order."""
    return F.array_compact(F.array(*[
        F.when(~is_filled(df, f), F.lit(f)) for f in fields
    ]))


def require_fields(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reason``)."""
    ok = reduce(and_, [is_filled(df, f) for f in fields])
    reason = F.concat(F.lit("missing: "), F.array_join(missing_fields(df, fields), ","))
    return df.filter(ok), df.filter(~ok).withColumn("reason", reason)


def filter_length(df: DataFrame, col: str, min_chars: int = 10,
                  max_chars: int = 10000) -> DataFrame:
    """Length in code points, inclusive at both ends; null rows are dropped.

    Written as one comparison, because Catalyst copies a computed text into every
    comparison that reads it.
    """
    return df.filter(F.abs(2 * F.length(col) - (min_chars + max_chars)) <= max_chars - min_chars)


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose texts are not blank and whose lists are not empty."""
    tests = [
        F.size(c) > 0 if isinstance(df.schema[c].dataType, T.ArrayType) else ~is_blank(c)
        for c in cols
    ]
    return df.filter(reduce(and_, tests))


def reject_unparsed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows whose path could not be parsed (any of ``cols`` is 'ERROR')."""
    return df.filter(~reduce(or_, [F.col(c) == "ERROR" for c in cols]))


def remaining(df: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not in ``done``. ``None`` means that no output exists yet."""
    if done is None:
        return df
    return df.join(done.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def text_digest(col: str) -> Column:
    """Fixed-width stand-in for a text in shuffles; all nulls share one value."""
    return F.coalesce(F.unhex(F.sha2(F.col(col).cast("string"), 256)), F.lit(b"null"))


def dedup(df: DataFrame, col: str, keep: str | bool = "first",
          order_col: str | Sequence[str] = "id") -> DataFrame:
    """One row per value of ``col``: the first or last by ``order_col``, or none of a
    repeated value (``keep=False``). ``order_col`` must identify a row.

    Only digests are shuffled to find the repeated values, and they are combined before
    the shuffle, so a text that fills a third of the table costs one row per map task. The
    list of repeated values is stored and counted: when it is small it is broadcast and the
    rows themselves are not shuffled at all, otherwise they are joined by digest, where AQE
    splits a hot one (the list has one row per value).
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    # A plain number stays in a hash aggregate, a struct would force a sort.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    pick = F.max(place) if keep == "last" else F.min(place)
    keyed = df.withColumn("_digest", text_digest(col))
    repeated = (keyed.groupBy("_digest")
                .agg(F.count(F.lit(1)).alias("_n"), pick.alias("_kept"))
                .filter("_n > 1").select("_digest", "_kept"))
    repeated = broadcast_if_small(cut_lineage(repeated))
    if keep is False:
        return keyed.join(repeated, "_digest", "left_anti").drop("_digest")
    return (keyed.join(repeated, "_digest", "left")
            .filter(F.col("_kept").isNull() | (F.col("_kept") == place))
            .drop("_digest", "_kept"))


def merge_collections(existing: DataFrame | None, new: DataFrame, text_col: str,
                      order_col: str) -> DataFrame:
    """Existing rows win over new rows with the same text. Without an existing
    collection the new one passes through as it is."""
    if existing is None:
        return new
    both = (existing.withColumn("_side", F.lit(0))
            .unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    return dedup(both, text_col, "first", ["_side", order_col]).drop("_side")


def count_removed(before: Sequence[DataFrame], after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows removed."""
    sizes = [d.select(F.lit(1).alias("b"), F.lit(0).alias("a")) for d in before]
    sizes.append(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    both = reduce(DataFrame.unionAll, sizes)
    return both.agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"),
                    (F.sum("b") - F.sum("a")).alias("n_removed"))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace a column by a costly expression. Filters on the result stay above it; as a
    plain projection Catalyst would copy the expression into each of them."""
    others = [c for c in df.columns if c != name]
    return (df.select(*others, F.explode(F.array(value)).alias(name))
            .select(*df.columns))


def preprocess(df: DataFrame, text_col: str, order_col: str, min_chars: int = 10,
               max_chars: int = 5000) -> DataFrame:
    """Clean white space, filter by length, drop repeats (first wins), drop blanks."""
    cleaned = computed_once(df, text_col, clean_whitespace(text_col))
    sized = filter_length(cleaned, text_col, min_chars, max_chars)
    kept = dedup(sized, text_col, "first", order_col)
    # Cleaned text of one character or more cannot be blank.
    return kept if min_chars >= 1 else kept.filter(F.col(text_col) != "")


def preprocess_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Initial and final row counts and the percentage retained."""
    counts = count_removed([before], after)
    return counts.select(
        F.col("n_before").alias("n_initial"), F.col("n_after").alias("n_final"),
        F.round(F.try_divide(100.0 * F.col("n_after"), F.col("n_before")), 6)
        .alias("pct_retained"))


def dataset_checks(df: DataFrame, text_col: str, fields: Sequence[str], min_chars: int = 10,
                   max_chars: int = 10000) -> DataFrame:
    """One pass over the table: missing fields, lengths and repeated texts."""
    size = F.length(text_col)
    checks = [F.count_if(~is_filled(df, f)).alias(f"missing_{f}") for f in fields]
    return (df.withColumn("_digest", text_digest(text_col)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *checks,
        F.count_if(size < min_chars).alias("n_too_short"),
        F.count_if(size > max_chars).alias("n_too_long"),
        (F.count(F.lit(1)) - F.count_distinct("_digest")).alias("n_repeated"),
        F.min(size).cast("long").alias("min_chars"),
        F.max(size).cast("long").alias("max_chars"),
        F.round(F.avg(size), 6).alias("mean_chars")))


#: Size parameter of the length sketches; a quantile's rank is off by at most SKETCH_ERROR of the
#: rows (with 99 % confidence), and exact up to about SKETCH_SIZE rows.
SKETCH_SIZE, SKETCH_ERROR = 4096, 0.0013


def length_sketches(df: DataFrame, text_col: str, part_cols: Sequence[str] = ()) -> DataFrame:
    """(parts, n, min_chars, max_chars, sketch): the text lengths of each part of the table as a
    mergeable quantile sketch (KLL) of a few dozen kilobytes. Null texts don't count.

    Store the rows of each new load: ``length_quantiles`` merges what is stored, so checks of a
    growing table read the new texts only. Tasks sketch their own rows; a hot part is combined
    before the shuffle.
    """
    size = F.length(text_col).cast("long")
    return df.filter(size.isNotNull()).groupBy(*part_cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"), F.kll_sketch_agg_bigint(size, SKETCH_SIZE).alias("sketch"))


def length_quantiles(sketches: DataFrame, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95),
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups, share, n_chars, n): length quantiles over stored sketches, merged by group. A value
    has a rank within SKETCH_ERROR of its share; no sketches: no rows."""
    merged = sketches.filter("n > 0").groupBy(*group_cols).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", SKETCH_SIZE).alias("sketch"))
    rows = merged.filter("n > 0").select(*group_cols, "n", F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("share"),
                 F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("n_chars"))
        for q in shares])).alias("q"))
    return rows.select(*group_cols, "q.share", "q.n_chars", "n")
