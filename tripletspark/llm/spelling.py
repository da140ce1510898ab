"""Spelling variants: words within one edit of each other, by asymmetric q-chunks.

Of two words within one edit the longer one (of equal length: each) contributes two disjoint
chunks, its front and its back half; the other contributes its grams of the chunks' lengths. One
edit lies in one half, so the other half is a gram of the other word, at a position shifted by
one at most. The lengths tell the shift: none for the front half, and for the back half the
difference of the lengths; grams at other positions meet no chunk of such a pair and are not
made. So a word of L letters is held under its two halves as a word of that length, and under
two grams as the shorter partner of words of L + 1 letters.

Words that share a key are compared, unless they are many: then the letters that the key does
not cover are halved again, and so on down to single letters, where the alphabet bounds a group.
No pair within one edit is lost by that, as one half of the rest is preserved each time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import texts
from tripletspark.session import broadcast_if_small, cut_lineage

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Keys of more words are split.
GROUP = 32
#: Words that a task holds before it hands their counts on.
HELD = 200_000

_RUN = re.compile("[a-z\u00c0-\u00ff]+")


def spoilt(run: str, doc_id: int | None, one_in: int) -> str:
    """``run`` without one letter where ``one_in`` divides the crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                spoil: int | None = None) -> DataFrame:
    """word, n: runs of Latin letters of all texts, A-Z lower-cased, of at least ``min_chars``
    letters and ``min_count`` occurrences. ``spoil``: a letter is left out of some runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array(list(total.values()), pa.int64())],
                names=["word", "n"])
            total.clear()
            return rows
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    strict=True):
                # Bytes are lower-cased as ASCII only.
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if spoil:
                        word = spoilt(word, doc_id, spoil)
                    if len(word) >= min_chars:
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
        if total:
            yield out()
    rows = texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _chunks(rows: DataFrame) -> DataFrame:
    """Each row under its two next keys. A row covers ``front`` and ``back`` letters of its
    word, which stands for a partner of ``size`` letters; the rest is halved."""
    half = F.floor((F.col("size") - F.col("front") - F.col("back")) / 2).cast("int")
    rest = F.col("size") - F.col("front") - F.col("back")
    kept = F.explode(F.array(
        F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back")),
        F.struct(F.col("front").alias("front"), (F.col("back") + rest - half).alias("back"))))
    rows = rows.select("word", "n", "size", kept.alias("k")).select(
        "word", "n", "size", "k.front", "k.back")
    return rows.withColumn("key", _key())


def _key() -> Column:
    """A hash of the letters covered and where they lie; the check behind the join makes up for
    chance meetings."""
    word = F.col("word")
    return F.xxhash64(
        "size", "front", "back", F.substring(word, F.lit(1), F.col("front")),
        F.substring(word, F.char_length(word) - F.col("back") + 1, F.col("back")))


def near_links(words: DataFrame, group: int = GROUP) -> DataFrame:
    """a, na, b, nb: each pair of ``words`` (word, n; words are distinct and of two letters at
    least) that differ by exactly one inserted, deleted or replaced letter, once."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("size"),
                        F.lit(0).alias("front"), F.lit(0).alias("back"))
    done = []
    while True:
        rows = cut_lineage(_chunks(rows))
        many = (rows.groupBy("key").agg(F.count("*").alias("n_key"), F.min(
            F.col("size") - F.col("front") - F.col("back")).alias("rest"))
            .where((F.col("n_key") > group) & (F.col("rest") > 1)).select("key"))
        many = cut_lineage(many)
        if many.isEmpty():
            done.append(rows)
            break
        small = broadcast_if_small(many)
        done.append(rows.join(small, "key", "left_anti"))
        rows = rows.join(small, "key", "left_semi")
    keyed = done[0]
    for more in done[1:]:
        keyed = keyed.unionByName(more)
    full = F.char_length("word") == F.col("size")
    longer = keyed.where(full).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    other = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("nb"),
                         full.alias("full"))
    pairs = longer.join(other, "key").where(
        (~F.col("full") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "na", "b", "nb").distinct()


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: forms followed to the last, by doubling. A form occurs ``ratio`` times as
    often as its word, so a chain has at most log(n) links."""
    most = forms.agg(F.max("form_n")).first()[0]
    links = max(1, math.ceil(math.log(most) / math.log(ratio))) if most else 1
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(links.bit_length()):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = cut_lineage(
            reached.join(broadcast_if_small(ahead), "root", "left")
            .select("word", F.coalesce("further", "root").alias("root")))
    return reached


def group_variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = cut_lineage(words)
    links = cut_lineage(near_links(words, group))
    both = links.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")
                        ).unionByName(links.select(F.col("b").alias("word"),
                                                   F.col("a").alias("near"),
                                                   F.col("na").alias("m")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("best"))
    often = -F.col("best.less") >= ratio * F.col("n")
    out = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"),
        F.when(often, -F.col("best.less")).alias("form_n")))
    roots = _roots(out.where(F.col("form").isNotNull()), ratio)
    return (out.join(broadcast_if_small(roots), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                    "form_n"))


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, spoil: int | None = None,
                      group: int = GROUP) -> DataFrame:
    """One row per word of the documents: its near word of largest count (``form``; ties: the
    smallest), if that occurs ``ratio`` times as often, and the last form in the chain.

    Null and empty texts have no words, a null doc_id is an empty string where letters are left
    out; repeated rows count as often as they occur; words of any length are compared whole; other
    columns stay out. No words: no rows.
    """
    return group_variants(count_words(docs, min_chars, min_count, spoil), ratio, group)
