"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules here: blank, tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more``; other columns, clashing names too, stay out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fixed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, behind a generator: the optimizer can't copy a costly column
    into the expressions and filters (or lambdas) that use it, where it would be computed for
    each element again."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


class Whole:
    """All columns of documents under names of their own, so that none clashes with those an
    operator adds; and the way back."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = [f"_c{i}" for i in range(len(self.columns))]
        self.df = docs.toDF(*self.names)
        self.doc_id = F.col(self.names[self.columns.index("doc_id")]).cast("long")
        self.raw = F.col(self.names[self.columns.index("text")])
        self.text = F.coalesce(self.raw, F.lit(""))
        self.digest = F.xxhash64(self.text)

    def back(self, df: DataFrame, **new: Column) -> DataFrame:
        """The columns of the documents, some of them anew."""
        return df.select(*[new.get(c, F.col(n)).alias(c)
                           for c, n in zip(self.columns, self.names, strict=True)])

    def without_lines(self, df: DataFrame, removed: str) -> DataFrame:
        """The documents without the lines at the places in column ``removed`` (null: whole),
        n_chars (if there) following the text."""
        df = fixed(df, [*self.names, removed], _lines=F.split(self.text, "\n", -1))
        lines = F.col("_lines")
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
        cut = F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")
        df = fixed(df, self.names, _text=F.when(F.col(removed).isNull(), self.raw).otherwise(cut))
        return self.back(df, text=F.col("_text"),
                         n_chars=F.char_length("_text").cast("long"))
