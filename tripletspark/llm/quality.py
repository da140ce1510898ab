"""Quality rules: counts within each text, and line frequency across the documents of a host.

Only built-in functions. The counts stay within a row (no shuffle); what is shuffled for the
line rule is one narrow row per line (hash and length), never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import SPACE, SPACE_CHARS, Whole, fixed, texts, words
from tripletspark.session import broadcast_if_small, cut_lineage

SYMBOLS = "#*$%&|<>"
_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def text_counts(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and, of the non-null column text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words.

    Equal three-word windows are found by a 64-bit hash within one text: only texts with a
    repeated hash sort theirs; each flagged window then adds the words it newly covers.
    """
    text, keep = F.col("text"), list(keep)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_HAS_WORD))
    df = fixed(df, keep, _words=words(text), _lines=lines,
               word_chars=_without(text, SPACE_CHARS).cast("long"),
               n_symbols=(F.char_length(text) - _without(text, SYMBOLS)).cast("long"))
    w, n = F.col("_words"), F.size("_words")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1),
                                                          F.get(w, i + 2))))
    unique_lines = F.size(F.array_distinct("_lines"))
    df = fixed(df, [*keep, "word_chars", "n_symbols"], n_words=n.cast("long"),
               n_dup_lines=(F.size("_lines") - unique_lines).cast("long"), _h=windows)
    keep += ["word_chars", "n_symbols", "n_words", "n_dup_lines"]
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = fixed(df, keep, _z=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked))
    z = F.col("_z")
    places = F.transform(z, lambda x, i: F.when(
        (F.get(z, i - 1)["h"] == x["h"]) | (F.get(z, i + 1)["h"] == x["h"]), x["i"]))
    flagged = F.sort_array(F.filter(places, lambda x: x.isNotNull()))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(flagged, start, lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"])
    return fixed(df, keep, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))


def document_lines(df: DataFrame) -> DataFrame:
    """A row per line that has a word: doc_id, digest (of the text), host, pos, line (hash of the
    normalised line: lower case, white space as one blank, digits alike) and its characters."""
    raw = df.select("doc_id", F.xxhash64("text").alias("digest"),
                    F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"),
                    F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    bare = F.btrim(F.col("raw"), F.lit(SPACE_CHARS))
    norm = F.regexp_replace(F.regexp_replace(F.lower(bare), SPACE, " "), "[0-9]+", "0")
    return raw.where(F.col("raw").rlike(_HAS_WORD)).select(
        "doc_id", "digest", "host", "pos", F.xxhash64(norm).alias("line"),
        _without(F.col("raw"), SPACE_CHARS).alias("chars"))


def frequent_lines(lines: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """host, line, keeper: lines in more distinct documents of a host than either limit allows,
    and the smallest doc_id that holds it. Counted in two steps, so a line that most documents
    share is spread by document first."""
    doc = F.struct("doc_id")
    hosts = lines.groupBy("host").agg(F.count_distinct(doc).alias("docs"))
    seen = (lines.groupBy("host", "line")
            .agg(F.count_distinct(doc).alias("n"), F.min("doc_id").alias("keeper"))
            .where(F.col("n") > max_docs))
    return (seen.join(hosts, "host").where(F.col("n") > F.col("docs") * max_share)
            .select("host", "line", "keeper"))


def removed_lines(df: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """doc_id, digest, removed (places of the lines to remove), lost (their characters)."""
    lines = document_lines(df)
    often = broadcast_if_small(cut_lineage(frequent_lines(lines, max_docs, max_share)))
    return (lines.join(often, ["host", "line"])
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .select("doc_id", "digest", "pos", "chars").distinct()
            .groupBy("doc_id", "digest")
            .agg(F.collect_list("pos").alias("removed"), F.sum("chars").alias("lost")))


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["digest"].eqNullSafe(b["digest"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = 50,
                  max_share: float = 0.001, min_left: float = 0.3, min_words: int = 50,
                  max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, lines_removed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in
    repeated three-word windows. A line goes from a document if more than ``max_docs`` distinct
    documents of its host and more than ``max_share`` of them hold it; the document with the
    smallest doc_id keeps it, so no content leaves a host altogether. A document is depleted,
    and not kept, if less than ``min_left`` of its word characters remain. Null text: no words,
    fails. Null host: a host of its own. Repeated rows of a doc_id count once as a document.
    """
    df = texts(docs, F.col(host).alias("host"))
    counts = text_counts(df.withColumn("digest", F.xxhash64("text")), "doc_id", "digest")
    gone = removed_lines(df, max_docs, max_share).withColumn("n", F.size("removed"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("word_chars") - F.coalesce("lost", F.lit(0))
    return counts.join(gone, _same_document(counts, gone), "left").select(
        counts["doc_id"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce("n", F.lit(0)).cast("long").alias("lines_removed"),
        (~failed & (left >= min_left * F.col("word_chars"))).alias("kept"))


def apply_quality(docs: DataFrame, host: str = "source", max_docs: int = 50,
                  max_share: float = 0.001, min_left: float = 0.3, min_words: int = 50,
                  max_repeat_percent: int = 50) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with the columns of ``docs``: frequent lines
    are cut out of the text, n_chars (if there) follows it."""
    df = texts(docs, F.col(host).alias("host"))
    gone = removed_lines(df, max_docs, max_share)
    whole = Whole(docs)
    own = whole.df.select("*", whole.doc_id.alias("doc_id"), whole.text.alias("text"),
                          whole.digest.alias("digest"))
    own = text_counts(own, *whole.names, "doc_id", "digest")
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("word_chars") - F.coalesce("lost", F.lit(0))
    kept = own.join(gone, _same_document(own, gone), "left").where(
        F.when(failed, F.lit(False)).otherwise(left >= min_left * F.col("word_chars")))
    return whole.without_lines(kept, "removed")
