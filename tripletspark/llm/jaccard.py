"""Near duplicates by SimHash and the Jaccard similarity of their word shingles.

Fingerprints over the shingles are linked by pigeonring (see simhash); a link counts if the whole
sets reach the threshold. Most pairs near the threshold have fingerprints too far apart for that,
so an exact prefix join follows, which starts from what is linked already.

A text is the set of its shingles' 64-bit hashes. Of two sets that reach the threshold t, each
has at least t of its n hashes in the other, so under any common order of all hashes they share
one among the first n - ceil(t * n) + 1 of each. These are the keys of an exact join. The order is
that of frequency over all texts, estimated by a sketch of bounded size (counts by hash, added up
over the tasks): an estimate is enough, since any common order keeps the join exact, and what
many texts hold leaves the keys for good as long as they own rarer runs.

Texts that share a key are held against the key's first text, then, of what these links did not
join, against each other: tasks that hold a key's texts as short bit vectors (parities of the
sets) compare them and hand on only pairs that the sizes and parities allow. A key of many texts
is dealt to pairs of blocks. What is handed on is confirmed on the whole sets, so nothing is lost
and nothing is linked below the threshold.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.llm.components import components
from tripletspark.llm.simhash import SEED, fingerprints, hamming_links, keep_first
from tripletspark.llm.tables import texts
from tripletspark.session import broadcast_if_small, cut_lineage

WIDTH, THRESHOLD = 5, 0.8
#: Counters of the sketch of frequencies, and its parts.
CELLS, SLOTS = 1 << 21, 64
#: Texts left under a key that a task compares with each other; more are cut into blocks.
GROUP = 2048
#: Rounds against a key's first text before all that is left meets.
STARS = 2
#: A task skips texts that it has just seen.
RECENT = 100_000
#: Parities of a set, and partners that meet one copy of a text.
BITS, BLOCK = 512, 256
EPSILON = 1e-9
#: Differing bits at which SimHash fingerprints make candidates.
NEAR_BITS = 3


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, sorted; a shorter text is one run."""
    found = text.encode().lower().split()
    runs = (map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))
            if len(found) >= width else [b" ".join(found)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64)
                     .view(np.int64))


def _new_sets(width: int, batches: Iterator[pa.RecordBatch]
              ) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Digest and hashes of each text, batch by batch; not of those that the task has just seen."""
    recent: OrderedDict[int, None] = OrderedDict()
    for batch in batches:
        found = []
        for doc, text in zip(batch.column("digest").to_pylist(),
                             batch.column("text").to_pylist(), strict=True):
            if doc in recent:
                continue
            recent[doc] = None
            if len(recent) > RECENT:
                recent.popitem(last=False)
            found.append((doc, shingles(text, width)))
        yield found


def sketch(own: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """How often hashes occur, by their lowest bits and at quarter powers of two: one byte a
    counter. A task's counts end at 255 and are added up part by part; ``cells`` bytes reach the
    driver, whatever the number of texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int32)
        for sets in _new_sets(width, batches):
            if sets:
                at = np.concatenate([x for _, x in sets]) & (cells - 1)
                counts += np.bincount(at, minlength=cells).astype(np.int32)
        if counts.any():
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(SLOTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SLOTS)), pa.array([x.tobytes() for x in parts])],
                names=["slot", "counts"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = None, 0

        def out() -> pa.RecordBatch:
            level = np.floor(4 * np.log2(total + 1.0)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([level.tobytes()])],
                                              names=["slot", "level"])
        for batch in group:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                              strict=True):
                if s != slot and slot is not None:
                    yield out()
                if s != slot:
                    slot, total = s, np.zeros(cells // SLOTS, np.int64)
                total = total + np.frombuffer(raw, np.uint8)
        if slot is not None:
            yield out()
    rows = (own.mapInArrow(count, "slot long, counts binary").repartition(SLOTS, "slot")
            .sortWithinPartitions("slot").mapInArrow(add, "slot long, level binary").collect())
    level = np.zeros((SLOTS, cells // SLOTS), np.uint8)
    for r in rows:
        level[r.slot] = np.frombuffer(r.level, np.uint8)
    return level.ravel()


def prefix(hashes: np.ndarray, threshold: float, level: np.ndarray) -> np.ndarray:
    """The first hashes of a set, rarer ones (by ``level``) first: sets that reach the threshold
    have one of them in common."""
    n = len(hashes)
    order = np.argsort(level[hashes & (len(level) - 1)], kind="stable")
    return hashes[order][:n - math.ceil(threshold * n - EPSILON) + 1]


def _members(own: DataFrame, width: int, threshold: float, level) -> DataFrame:
    """key, doc (the text's digest), n (the size of its set) of keys that different texts share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _new_sets(width, batches):
            if sets:
                keys = [prefix(x, threshold, level.value) for _, x in sets]
                sizes = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)),
                     pa.array(np.repeat(np.array([d for d, _ in sets], np.int64), sizes)),
                     pa.array(np.repeat(np.array([len(x) for _, x in sets], np.int64), sizes))],
                    names=["key", "doc", "n"])
    # A window, not an aggregate and a join: keys that only one text has, nearly all, are shuffled
    # once and stored nowhere. A key's rows are three numbers each.
    by = Window.partitionBy("key")
    rows = own.mapInArrow(run, "key long, doc long, n long")
    rows = rows.withColumn("low", F.min("doc").over(by)).withColumn("high", F.max("doc").over(by))
    return cut_lineage(rows.where(F.col("low") < F.col("high"))
                       .groupBy("key", "doc").agg(F.min("n").alias("n")))


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """The rows of keys under which ``by`` differs. The bounds come from an aggregate, a hot key
    is never in one task."""
    rows = cut_lineage(rows)
    ends = rows.groupBy("key").agg(F.min(by).alias("low"), F.max(by).alias("high")).where(
        F.col("low") < F.col("high")).select("key")
    return cut_lineage(rows.join(ends, "key", "left_semi"))


def _fits(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= threshold * F.greatest(n, m) - EPSILON


def parities(hashes: np.ndarray) -> list[int]:
    """BITS parities of a set's hashes: those of two sets differ in at most as many bits as there
    are hashes that only one of the sets has."""
    odd = np.bincount(hashes & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _marks(own: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc, odd (the parities) of the texts in ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _new_sets(width, batches):
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in sets], pa.int64()),
                     pa.array([parities(x) for _, x in sets], pa.list_(pa.int64()))],
                    names=["doc", "odd"])
    asked = own.join(broadcast_if_small(docs.withColumnRenamed("doc", "digest")), "digest",
                     "left_semi").select("text", "digest")
    return cut_lineage(asked.mapInArrow(run, "doc long, odd array<long>").dropDuplicates(["doc"]))


def _most(n: Column | np.ndarray, m: Column | np.ndarray, threshold: float):
    """In how many hashes sets of these sizes may differ."""
    return (1 - threshold) / (1 + threshold) * (n + m) + EPSILON


def _possible(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, na, b, nb) whose parities allow the threshold, as a, b."""
    a, b = (marks.select(F.col("doc").alias(x), F.col("odd").alias(f"odd{x}")) for x in "ab")
    differ = sum((F.bit_count(F.get("odda", F.lit(k)).bitwiseXOR(F.get("oddb", F.lit(k))))
                  for k in range(BITS // 64)), F.lit(0))
    return (pairs.join(a, "a").join(b, "b")
            .where(differ <= _most(F.col("na"), F.col("nb"), threshold)).select("a", "b"))


def _meet(threshold: float):
    """Over rows (key, i, j, side, doc, n, root, odd) sorted by the first four: the pairs of
    different roots, of a block with itself or of two blocks, that sizes and parities allow."""
    def pairs(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        (doc, n, root, odd), (doc2, n2, root2, odd2) = x, y
        fit = ((root[:, None] != root2[None, :])
               & (np.minimum(n[:, None], n2[None, :])
                  >= threshold * np.maximum(n[:, None], n2[None, :]) - EPSILON))
        r, c = np.nonzero(fit)
        differ = np.bitwise_count(odd[r] ^ odd2[c]).sum(axis=1)
        keep = differ <= _most(n[r], n2[c], threshold)
        return doc[r[keep]], doc2[c[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, side, doc, n, root = (batch.column(k).to_numpy() for k in range(7))
            # Unsigned: the bits of a negative number would be counted without its sign.
            odd = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
            new = np.r_[True, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
                        | (np.diff(side) != 0)]
            starts = np.nonzero(new)[0]
            left, right = [], []
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                if (key[s], i[s], j[s]) != current:
                    current, kept = (key[s], i[s], j[s]), []
                for at in range(s, e, 256):
                    to = min(at + 256, e)
                    rows = doc[at:to], n[at:to], root[at:to], odd[at:to]
                    if side[s] == 1 or i[s] == j[s]:
                        for old in kept:
                            a, b = pairs(old, rows)
                            left.append(a)
                            right.append(b)
                    if side[s] == 0:
                        if i[s] == j[s]:
                            a, b = pairs(rows, rows)
                            left.append(a[a < b])
                            right.append(b[a < b])
                        kept.append(rows)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return run


def _met(members: DataFrame, marks: DataFrame, threshold: float, group: int) -> DataFrame:
    """a, b: the pairs of members (key, doc, n, root) of one key that may reach the threshold."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    own, other = F.col("own"), F.col("other")
    dealt = (members.join(sizes, "key").join(marks, "doc")
             .withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"),
                     F.when(own <= other, 0).otherwise(1).alias("side"), "doc", "n", "root", "odd"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(parts, "key", "i", "j")
            .sortWithinPartitions("key", "i", "j", "side")
            .mapInArrow(_meet(threshold), "a long, b long"))


def _of(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """digest, text of what stands in ``pairs``."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    return (own.join(broadcast_if_small(ids), "digest", "left_semi").select("digest", "text"))


def _confirmed(own: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. Texts travel, since they are
    smaller than their sets; that of a once for BLOCK partners."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    dealt = cut_lineage(pairs.join(sizes, "a").select("a", "b", F.pmod(
        F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("block")))
    text = _of(own, pairs).dropDuplicates(["digest"])
    none = F.lit(None).cast("long")
    firsts = dealt.select("a", "block").distinct().join(
        text.withColumnRenamed("digest", "a"), "a").select("a", "block", none.alias("b"), "text")
    others = dealt.join(text.withColumnRenamed("digest", "b"), "b").select(
        "a", "block", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for a, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")),
                               strict=True):
                x = shingles(t, width)
                if b is None:
                    first = x
                    continue
                common = len(np.intersect1d(first, x, assume_unique=True))
                if common >= threshold * (len(first) + len(x) - common) - EPSILON:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()),
                 pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
    rows = firsts.unionByName(others)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartition(parts, "a", "block")
                       .sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
                       .mapInArrow(run, "a long, b long"))


def _by_fingerprint(own: DataFrame, width: int) -> DataFrame:
    """a, b: texts whose SimHash fingerprints are equal or linked by pigeonring at NEAR_BITS, of
    texts with one fingerprint each with the first."""
    marked = cut_lineage(fingerprints(own.select(F.col("digest").alias("doc_id"), "text"), width)
                         .select("digest", "fp").dropDuplicates(["digest"]))
    first = cut_lineage(marked.groupBy("fp").agg(F.min("digest").alias("first")))
    same = marked.join(first, "fp").where(F.col("digest") != F.col("first")).select(
        F.col("first").alias("a"), F.col("digest").alias("b"))
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"first{x}")) for x in "ab")
    near = hamming_links(first.select("fp"), NEAR_BITS).join(a, "a").join(b, "b").select(
        F.least("firsta", "firstb").alias("a"), F.greatest("firsta", "firstb").alias("b"))
    return same.union(near)


def similar_links(own: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
                  group: int = GROUP) -> DataFrame:
    """a, b: links between different texts (by digest) of at least ``threshold`` that join all
    that such links join. ``own``: text, digest."""
    level = own.sparkSession.sparkContext.broadcast(sketch(own, width))
    members = _members(own, width, threshold, level)
    marks = _marks(own, cut_lineage(members.select("doc").distinct()), width)
    found = own.sparkSession.createDataFrame([], "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.distinct())
        return found if pairs.isEmpty() else cut_lineage(
            found.union(_confirmed(own, pairs, width, threshold)))

    # The method's own links come first; the join by keys finds what fingerprints miss.
    found = confirmed(_by_fingerprint(own, width))
    members = members.join(components(found).withColumnRenamed("node", "doc"), "doc", "left"
                           ).withColumn("root", F.coalesce("root", "doc"))
    for _ in range(STARS):
        first = members.groupBy("key").agg(F.min(F.struct("doc", "n", "root")).alias("first"))
        members = cut_lineage(members.join(first, "key").where(F.col("doc") != F.col("first.doc")))
        found = confirmed(_possible(
            members.where((F.col("root") != F.col("first.root"))
                          & _fits(F.col("n"), F.col("first.n"), threshold))
            .select(F.col("first.doc").alias("a"), F.col("first.n").alias("na"),
                    F.col("doc").alias("b"), F.col("n").alias("nb")).distinct(), marks, threshold))
        # The first text of a key is done; keys whose others are all joined are done, too.
        roots = components(found).withColumnRenamed("node", "doc")
        members = _shared(members.select("key", "doc", "n").join(roots, "doc", "left").withColumn(
            "root", F.coalesce("root", "doc")), "root")
    return confirmed(_met(members, marks, threshold, group))


def drop_similar(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component of texts whose shingles' Jaccard similarity
    is at least ``threshold``: the one of the smallest doc_id, of repeated rows any one.

    Words are runs without ASCII white space, A-Z lower-cased. Texts without words, null ones too,
    are alike. A text of fewer than ``width`` words is one run; long texts are read whole. A null
    doc_id counts behind all others; rows that are equal in doc_id and text become one; columns of
    any name go through. No documents: no rows.
    """
    own = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                             F.xxhash64("text").alias("digest"))
    roots = components(similar_links(own.select("text", "digest"), width, threshold))
    marked = own.select("doc_id", "digest").join(
        roots, F.col("digest") == roots["node"], "left").select(
        "doc_id", "digest", F.coalesce("root", "digest").alias("root"))
    return keep_first(docs, marked)
