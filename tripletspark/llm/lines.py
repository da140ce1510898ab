"""Line dedup: exact classes of lines, joined by a segment-partition edit join.

A line is lower-cased with white space as single blanks, and known by a 64-bit hash. Equal lines
meet in one aggregation. For the edit join a line of length n is cut into ``edits`` + 1 segments;
two lines within ``edits`` edits share one of the shorter line's segments, at nearly its place.
So the longer line looks up only the substrings that the shorter one's length allows. Keys hold
length, segment and hash, and are shuffled without texts; only keys that two different lines
share get their texts attached and are verified, by a bit-parallel automaton over the band of
2 * ``edits`` + 1 diagonals that runs many pairs at once.

Groups leave as spanning links and counts, never as all pairs. A group of more than ``GROUP``
lines is dealt out as pairs of blocks, so no task holds it whole.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.llm.components import components
from tripletspark.llm.tables import Whole, texts
from tripletspark.session import cut_lineage

EDITS = 2
#: Lines of MIN_CHARS have a class, those below NEAR_CHARS meet equal lines only.
MIN_CHARS, NEAR_CHARS = 1, 16
#: Shorter lines stay in a cleaned text, even if another text has them.
DROP_CHARS = 16
GROUP = 1000
#: Pairs verified together, and the characters that they may have together.
PAIRS, CELLS = 4096, 1 << 21
#: A task skips lines that it has just seen.
RECENT = 100_000


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a line of length n; the last ones take the remainder."""
    size, rest = divmod(n, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        own = size + (k >= edits + 1 - rest)
        out.append((at, own))
        at += own
    return out


def line_keys(line: str, edits: int) -> tuple[list[int], list[int]]:
    """Keys under which a line is indexed, and those under which it looks for lines of its own
    length (at another place) or shorter. If the k-th segment is the first that matches, at most
    k edits lie before it and edits - k after it, which bounds the places to look."""
    def key(at: int, size: int, n: int, k: int) -> int:
        return xxhash.xxh64_intdigest(line[at:at + size], n * (edits + 1) + k) - (1 << 63)
    own, probes = [], []
    length = len(line)
    for n in range(max(edits + 1, length - edits), length + 1):
        more = length - n
        for k, (at, size) in enumerate(segments(n, edits)):
            if n == length:
                own.append(key(at, size, n, k))
            low = max(0, at - k, at + more - (edits - k))
            high = min(length - size, at + k, at + more + edits - k)
            probes += [key(p, size, n, k) for p in range(low, high + 1)
                       if n != length or p != at]
    return own, probes


def within(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Which pairs of code-point arrays are within ``edits`` edits.

    For d errors, bit k of a pair's state says that the first j + k - edits characters of a and
    the first j of b match with at most d errors. A step takes the next character of b for all
    pairs; pairs without any state left drop out.
    """
    wide = max(max(map(len, a)), max(map(len, b)))
    left = np.zeros((len(a), wide + 2 * edits + 1), np.uint32)
    right = np.full((len(b), wide), 1 << 30, np.uint32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, edits:edits + len(x)] = x + 1
        right[i, :len(y)] = y + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(len(a), bool)
    mask = np.uint16((1 << (2 * edits + 1)) - 1)
    alive = np.flatnonzero(np.abs(la - lb) <= edits)
    state = [np.full(len(alive), sum(1 << (edits + i) for i in range(d + 1)), np.uint16)
             for d in range(edits + 1)]
    for j in range(wide + 1):
        ends = lb[alive] == j
        if ends.any():
            bit = (la - lb)[alive[ends]] + edits
            out[alive[ends]] = (state[edits][ends] >> bit.astype(np.uint16)) & 1
        stay = ~ends & (state[edits] > 0)
        if not stay.all():
            alive, state = alive[stay], [s[stay] for s in state]
        if not len(alive):
            break
        now = right[alive, j]
        same = np.zeros(len(alive), np.uint16)
        for k in range(2 * edits + 1):
            same |= (left[alive, j + k] == now).astype(np.uint16) << np.uint16(k)
        new = [state[0] & same]
        for d in range(1, edits + 1):
            new.append((state[d] & same | state[d - 1] | state[d - 1] >> 1 | new[d - 1] << 1)
                       & mask)
        state = new
    return out


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
    """Row, place and normalised line of all lines of a batch that have a word."""
    for row, text in enumerate(batch.column("text").to_pylist()):
        for pos, raw in enumerate(text.split("\n")):
            if line := normal(raw):
                yield row, pos, line


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, digest (of the text), pos, line (its hash; null below ``min_chars`` characters),
    chars: one row per line that has a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, ids, chars = [], [], [], []
            for row, p, line in _lines(batch):
                rows.append(row)
                pos.append(p)
                ids.append(line_id(line) if len(line) >= min_chars else None)
                chars.append(len(line))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("digest").take(at),
                 pa.array(pos, pa.int32()), pa.array(ids, pa.int64()),
                 pa.array(chars, pa.int64())], names=["doc_id", "digest", "pos", "line", "chars"])
    return docs.mapInArrow(run, "doc_id long, digest long, pos int, line long, chars long")


def _distinct_lines(batches: Iterator[pa.RecordBatch], min_chars: int
                    ) -> Iterator[list[tuple[int, str]]]:
    """Hash and text of the lines of each batch, without those seen lately in this task."""
    recent: OrderedDict[int, None] = OrderedDict()
    for batch in batches:
        out = []
        for _, _, line in _lines(batch):
            if len(line) < min_chars or (own := line_id(line)) in recent:
                continue
            recent[own] = None
            if len(recent) > RECENT:
                recent.popitem(last=False)
            out.append((own, line))
            if len(out) == 20_000:
                yield out
                out = []
        yield out


def all_keys(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """key, line, indexed: a row for each key of a line (some again, from other tasks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _distinct_lines(batches, min_chars):
            keys, ids, side = [], [], []
            for own, line in lines:
                index, probes = line_keys(line, edits)
                keys += index
                keys += probes
                ids.append((own, len(index) + len(probes)))
                side += [True] * len(index)
                side += [False] * len(probes)
            owner = np.repeat(np.array([x for x, _ in ids], np.int64), [n for _, n in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)), pa.array(owner),
                 pa.array(np.array(side, bool))], names=["key", "line", "indexed"])
    return docs.mapInArrow(run, "key long, line long, indexed boolean")


def line_texts(docs: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """line, norm for the hashes in ``ids`` (column line, each once)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _distinct_lines(batches, min_chars):
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in lines], pa.int64()),
                 pa.array([x for _, x in lines], pa.string())], names=["line", "norm"])
    return (docs.mapInArrow(run, "line long, norm string").join(ids, "line")
            .groupBy("line").agg(F.min("norm").alias("norm")))


def _pairs(sizes: np.ndarray, indexed: np.ndarray, blocks: np.ndarray, edits: int
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's rows that may be within ``edits`` edits, a row at a time. Blocks of a
    split group meet each other only where the group was dealt to both."""
    n = len(sizes)
    split = blocks.min() != blocks.max()
    for i in range(n - 1):
        fits = (np.abs(sizes[i + 1:] - sizes[i]) <= edits) & (indexed[i + 1:] | indexed[i])
        if split:
            fits &= blocks[i + 1:] != blocks[i]
        j = i + 1 + np.flatnonzero(fits)
        yield np.full(len(j), i), j


class Verifier:
    """Groups of lines, verified many pairs at once: spanning links of each group, and counts in
    which a pair counts under its smallest common key only."""

    def __init__(self, edits: int):
        self.edits = edits
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.waiting = 0

    def over(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Results of whole groups (rows sorted by group and key): (line, line, 0) for links,
        (line, number, 1) for counts."""
        self.keys, self.ids = rows["key"].to_numpy(), rows["line"].to_numpy()
        self.lines = rows["norm"].tolist()
        self.root = np.arange(len(rows))
        self.cached: dict[int, tuple[set[int], set[int]]] = {}
        self.links: list[tuple[int, int]] = []
        self.counts = np.zeros(len(rows), np.int64)
        group = rows["group"].to_numpy()
        sizes = rows["norm"].str.len().to_numpy()
        indexed, blocks = rows["indexed"].to_numpy(bool), rows["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (self.keys[1:] != self.keys[:-1])
                                      | (group[1:] != group[:-1])])
        for s, e in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
            for i, j in _pairs(sizes[s:e], indexed[s:e], blocks[s:e], self.edits):
                self.left.append(s + i)
                self.right.append(s + j)
                self.waiting += len(i)
                if self.waiting >= PAIRS:
                    self.check(sizes)
        self.check(sizes)
        own = np.flatnonzero(self.counts)
        links = np.array(self.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.r_[self.ids[links[:, 0]], self.ids[own]],
                             "b": np.r_[self.ids[links[:, 1]], self.counts[own]],
                             "kind": np.r_[np.zeros(len(links), int), np.ones(len(own), int)]})

    def check(self, sizes: np.ndarray) -> None:
        if not self.waiting:
            return
        left, right = np.concatenate(self.left), np.concatenate(self.right)
        self.left, self.right, self.waiting = [], [], 0
        order = np.argsort(sizes[left], kind="stable")  # alike lengths run together
        at = 0
        while at < len(order):
            part = order[at:at + PAIRS]
            while len(part) > 1 and len(part) * sizes[left[part[-1]]] > CELLS:
                part = part[:len(part) // 2]
            at += len(part)
            rows = np.unique(np.r_[left[part], right[part]])
            codes = {i: np.frombuffer(self.lines[i].encode("utf-32-le"), np.uint32) for i in rows}
            held = within([codes[i] for i in left[part]], [codes[i] for i in right[part]],
                          self.edits)
            for k in part[held]:
                self.take(int(left[k]), int(right[k]))

    def take(self, i: int, j: int) -> None:
        for k in (i, j):
            if k not in self.cached:
                index, probes = line_keys(self.lines[k], self.edits)
                self.cached[k] = set(index), set(index + probes)
        (ia, all_a), (ib, all_b) = self.cached[i], self.cached[j]
        if min((ia & all_b) | (ib & all_a)) == self.keys[i]:
            self.counts[i] += 1
            self.counts[j] += 1
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[a] = b
            self.links.append((i, j))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x


def _verify(edits: int):
    """Over rows sorted by (group, key), a batch and the rest of its last group at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verifier, held = Verifier(edits), None
        for frame in frames:
            if not len(frame):
                continue
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = rows.iloc[-1]
            tail = ((rows["group"] == last["group"]) & (rows["key"] == last["key"])).to_numpy()
            held = rows[tail]
            if not tail.all():
                yield verifier.over(rows[~tail])
        if held is not None:
            yield verifier.over(held)
    return run


def edit_links(docs: DataFrame, edits: int = EDITS, min_chars: int = NEAR_CHARS) -> DataFrame:
    """a, b, kind: links between different lines within ``edits`` edits that join all that such
    links join (kind 0), and (line, number of its links, partial sums) (kind 1). ``docs``:
    doc_id, text, digest."""
    by = Window.partitionBy("key")
    # A line repeats under a key only if several tasks saw it.
    met = all_keys(docs, edits, min_chars)
    met = met.select("key", "line", "indexed", F.min("line").over(by).alias("low"),
                     F.max("line").over(by).alias("high"), F.max("indexed").over(by).alias("any"))
    met = cut_lineage(met.where(F.col("any") & (F.col("low") < F.col("high")))
                      .groupBy("key", "line").agg(F.max("indexed").alias("indexed")))
    found = cut_lineage(line_texts(docs, met.select("line").distinct(), min_chars))
    sizes = met.groupBy("key").agg(F.count("*").alias("n"))
    rows = met.join(sizes, "key").join(found, "line")
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    block = F.when(blocks > 1, F.pmod(F.xxhash64("line"), blocks)).otherwise(F.lit(0)).cast("int")
    rows = rows.select("key", "line", "indexed", "norm", block.alias("block"),
                       blocks.alias("blocks"))
    own = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(
        own, other) * F.col("blocks") + F.greatest(own, other))
    rows = rows.select("key", "line", "indexed", "norm", "block", F.explode(pairs).alias("group"))
    # Much work in few bytes: the number is given, so that it isn't coalesced.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "key", "group").sortWithinPartitions("group", "key")
            .mapInPandas(_verify(edits), "a long, b long, kind int"))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "pos")


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS,
                 near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row per line that has a word: doc_id, digest, pos, chars, class_doc and class_pos (the
    first line of its class by doc_id, digest, pos), n_links (to different lines) and kept.

    A class is what equality and links join. Lines below ``min_chars`` characters are left alone
    (class null, kept), those below ``near_chars`` join equal lines only. Repeated rows with the
    same doc_id and text count as one document; null doc_ids come last. Null and empty texts have
    no lines.
    """
    own = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                             F.xxhash64("text").alias("digest"))
    seen = cut_lineage(occurrences(own, min_chars))
    first = seen.where(F.col("line").isNotNull()).groupBy("line").agg(F.min(_first()).alias("first"))
    found = cut_lineage(edit_links(own, edits, max(near_chars, min_chars)))
    roots = components(found.where(F.col("kind") == 0))
    counts = (found.where(F.col("kind") == 1).groupBy(F.col("a").alias("node"))
              .agg(F.sum("b").alias("n_links")))
    linked = roots.join(counts, "node", "left")
    named = first.join(linked, first["line"] == linked["node"], "left").select(
        "line", "first", F.coalesce("root", "line").alias("root"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Only linked lines have a first line other than their own.
    best = (named.where(F.col("n_links") > 0).groupBy("root")
            .agg(F.min("first").alias("best")))
    named = named.join(best, "root", "left").select(
        "line", "n_links", F.coalesce("best", "first").alias("best"))
    out = seen.join(named, "line", "left")
    is_first = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
                & (F.col("digest") == F.col("best.digest")) & (F.col("pos") == F.col("best.pos")))
    return out.select("doc_id", "digest", "pos", "chars", F.col("best.doc_id").alias("class_doc"),
                      F.col("best.pos").alias("class_pos"), "n_links",
                      F.when(F.col("best").isNull(), F.lit(True)).otherwise(is_first)
                      .alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_left: float = 0.3, min_chars: int = DROP_CHARS,
                        **options) -> DataFrame:
    """``docs`` without the lines of ``min_chars`` characters that aren't the first of their
    class; n_chars (if there) follows the text. A document of whose characters less than
    ``min_left`` are left is taken for a copy and goes; one without any words stays."""
    lines = line_classes(docs, min_chars=min_chars, **options)
    gone = F.col("kept") == F.lit(False)
    cut = (lines.groupBy("doc_id", "digest").agg(
        F.sum("chars").alias("all"), F.sum(F.when(gone, F.col("chars")).otherwise(0)).alias("lost"),
        F.collect_set(F.when(gone, F.col("pos"))).alias("removed"))
        .where(F.col("lost") > 0)
        .select(F.col("doc_id").alias("_doc_id"), F.col("digest").alias("_digest"), "all", "lost",
                "removed"))
    whole = Whole(docs)
    on = whole.doc_id.eqNullSafe(cut["_doc_id"]) & (whole.digest == cut["_digest"])
    kept = whole.df.join(cut, on, "left").where(
        F.col("lost").isNull() | (F.col("all") - F.col("lost") >= min_left * F.col("all")))
    return whole.without_lines(kept, "removed")
