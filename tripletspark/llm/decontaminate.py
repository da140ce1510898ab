"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items come in blocks of bounded size; the documents are scanned twice for each block, and
never shuffled. The first scan counts the documents that hold each n-gram of the items. N-grams
that are rare, for their item, are its seeds: an item that leaked into many documents keeps its
seeds, however frequent they are. The second scan looks the seeds up, cuts the stretch of
text around them and aligns it with the item, word by word.

Words of many texts are hashed together in numpy, straight from their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import Whole, texts

NGRAM = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: ASCII letters and digits, and whatever isn't ASCII, make words; the rest separates them.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_STEPS = _POWERS[100:100 + NGRAM]
#: Texts that are hashed together have about so many bytes.
_GROUP_BYTES = 1 << 21


def word_hashes(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's first (and the end)."""
    parts = [t.lower().encode() for t in batch]
    sizes = np.array([len(p) + 1 for p in parts])
    buf = np.frombuffer(b" ".join([*parts, b""]).translate(_TABLE), np.uint8)
    word = buf != 32
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    own = np.flatnonzero(word)
    number = np.cumsum(np.bincount(start, minlength=len(buf)))[own] - 1
    spot = np.minimum(own - start[number], len(_POWERS) - 1)
    mixed = (buf[own].astype(np.uint64) + np.uint64(1)) * _POWERS[spot]
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(own) else own
    hashes = np.add.reduceat(mixed, first) if len(own) else mixed
    bounds = np.searchsorted(start, np.r_[0, np.cumsum(sizes)])
    return hashes ^ (hashes >> np.uint64(29)), bounds


def ngram_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each word that has one within its text, and these words' places."""
    n = len(words) - NGRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k, step in enumerate(_STEPS):
        h += words[k:k + n] * step
    owner_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + NGRAM <= owner_end)
    h = h[at]
    return h ^ (h >> np.uint64(31)), at


#: Words, with padding, of the stretches that are aligned together; a longer one goes alone.
CELLS = 1 << 17


class Lookup:
    """Places of sorted keys; most misses end at a table of their high bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.hint = np.zeros(1 << 20, bool)
        self.hint[keys >> np.uint64(44)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are keys, and which keys they are."""
        maybe = np.flatnonzero(self.hint[hashes >> np.uint64(44)])
        key = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[maybe]
        return maybe[hit], key[hit]


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of groups of about ``_GROUP_BYTES``."""
    column, at, held, size = batch.column("text"), 0, [], 0
    for k in range(len(column)):
        text = column[k].as_py()
        held.append(text)
        size += len(text)
        if size >= _GROUP_BYTES:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def document_counts(docs: DataFrame, keys: np.ndarray) -> dict[int, int]:
    """How many documents hold each key; the driver gets a number per key."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Lookup(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, group in grouped(batch):
                words, bounds = word_hashes(group)
                h, at = ngram_hashes(words, bounds)
                which, key = find(h)
                owner = np.searchsorted(bounds, at[which], "right")
                pairs = np.unique(owner * len(total) + key)
                total += np.bincount(pairs % len(total), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])],
                                         names=["key", "n"])
    rows = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in rows.collect()}


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its stretch, and where it ends there. All
    pairs advance together, a word of the items at a time; gaps along a row are a running
    maximum."""
    wide = max(map(len, stretches))
    text = np.zeros((len(items), wide), np.uint64)
    there = np.zeros((len(items), wide), bool)
    for k, s in enumerate(stretches):
        text[k, :len(s)], there[k, :len(s)] = s, True
    slope = np.arange(wide, dtype=np.int32) * -GAP
    row = np.zeros((len(items), wide), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    sizes = np.array([len(i) for i in items])
    every = np.arange(len(items))
    for j in range(sizes.max()):
        word = np.array([i[j] if j < len(i) else 0 for i in items], np.uint64)
        same = (text == word[:, None]) & there & (j < sizes)[:, None]
        before = np.c_[np.zeros(len(items), np.int32), row[:, :-1]]
        new = np.maximum(before + np.where(same, MATCH, MISMATCH), row + GAP)
        new = np.maximum(new, 0).astype(np.int32)
        row = np.maximum.accumulate(new + slope, 1) - slope
        top = row.argmax(1)
        better = row[every, top] > best
        best[better], end[better] = row[every, top][better], top[better]
    return best, end


class Index:
    """Items of a block, their n-grams and seeds."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        flat = np.concatenate([*words, np.zeros(0, np.uint64)])
        bounds = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        h, at = ngram_hashes(flat, bounds)
        self.hash, self.item = h, np.searchsorted(bounds, at, "right") - 1
        self.place = at - bounds[self.item]

    def choose(self, counts: dict[int, int], keys: np.ndarray, plain: int, factor: int) -> None:
        """Keep as seeds the n-grams that are rare for their item: in at most ``plain``
        documents, or in at most ``factor`` times as many as the item's median n-gram that
        occurs at all. An item's own spread raises that median with it."""
        n = np.zeros(len(keys), np.int64)
        for key, count in counts.items():
            n[key] = count
        number = n[np.searchsorted(keys, self.hash)]
        seen = np.flatnonzero(number)
        limit = np.full(len(self.ids), plain)
        order = seen[np.lexsort((number[seen], self.item[seen]))]
        item, first, total = np.unique(self.item[order], return_index=True, return_counts=True)
        limit[item] = np.maximum(plain, factor * number[order[first + total // 2]])
        keep = seen[number[seen] <= limit[self.item[seen]]]
        keep = keep[np.argsort(self.hash[keep], kind="stable")]
        self.hash, self.item, self.place = self.hash[keep], self.item[keep], self.place[keep]
        self.keys, self.at = np.unique(self.hash, return_index=True)
        self.at = np.r_[self.at, len(self.hash)]


def candidates(index: Index, find: Lookup, words: np.ndarray, bounds: np.ndarray,
               slack: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from, to): stretches of words around seeds; those of one item that touch are
    one, cut into windows where they are long."""
    h, at = ngram_hashes(words, bounds)
    which, key = find(h)
    reps = index.at[key + 1] - index.at[key]
    spot = np.repeat(index.at[key] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
    where = np.repeat(at[which], reps)
    owner = np.searchsorted(bounds, where, "right") - 1
    item = index.item[spot]
    start = where - index.place[spot] - slack
    size = np.array([len(w) for w in index.words])[item]
    lo = np.maximum(start, bounds[owner])
    hi = np.minimum(start + size + 2 * slack, bounds[owner + 1])
    order = np.lexsort((lo, item, owner))
    last = None
    for k in order:
        now = (int(owner[k]), int(item[k]))
        if last and last[:2] == now and lo[k] <= last[3]:
            last = (*now, last[2], max(last[3], int(hi[k])))
        else:
            if last:
                yield from windows(last, len(index.words[last[1]]), slack)
            last = (*now, int(lo[k]), int(hi[k]))
    if last:
        yield from windows(last, len(index.words[last[1]]), slack)


def windows(stretch: tuple[int, int, int, int], n: int, slack: int
            ) -> Iterator[tuple[int, int, int, int]]:
    """A long stretch (a text that repeats an item) in windows. A gap costs half of what a match
    gains, so an alignment of n words that scores at all spans less than 3 n words; windows overlap
    by that, and each alignment lies whole in one of them."""
    text, item, lo, hi = stretch
    overlap = 3 * n + 2 * slack
    while hi - lo > 4 * overlap:
        yield text, item, lo, lo + 2 * overlap
        lo += overlap
    yield text, item, lo, hi


def batches_of(todo: list[tuple[int, int, int, int]]) -> Iterator[list]:
    """Stretches, shortest first, that are aligned together: at most CELLS words with padding."""
    part: list = []
    for c in sorted(todo, key=lambda c: c[3] - c[2]):
        if part and (len(part) + 1) * (c[3] - c[2]) > CELLS:
            yield part
            part = []
        part.append(c)
    if part:
        yield part


def _scan(docs: DataFrame, index: Index, floor: float, least: int, slack: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        find = Lookup(own.keys)
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, int]] = {}
            for first, group in grouped(batch):
                words, bounds = word_hashes(group)
                for part in batches_of(list(candidates(own, find, words, bounds, slack))):
                    scores, ends = align([own.words[c[1]] for c in part],
                                         [words[c[2]:c[3]] for c in part])
                    for (d, k, lo, _), s, e in zip(part, scores.tolist(), ends.tolist(),
                                                   strict=True):
                        n = len(own.words[k])
                        if s >= floor * MATCH * n and s >= MATCH * min(least, n):
                            at = (first + d, k)
                            now = (s / (MATCH * n), -int(lo - bounds[d] + e))
                            found[at] = max(found.get(at, (0.0, 0)), now)
            rows = [k[0] for k in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                 batch.column("digest").take(pa.array(rows, pa.int64())),
                 pa.array([own.ids[k[1]] for k in found], pa.int64()),
                 pa.array([v[0] for v in found.values()], pa.float64()),
                 pa.array([-v[1] + 1 for v in found.values()], pa.int64())],
                names=["doc_id", "digest", "item_id", "score", "end_word"])
    return docs.mapInArrow(run, "doc_id long, digest long, item_id long, score double, "
                                "end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, floor: float = 0.5, least: int = 8,
                 plain: int = 100, factor: int = 4, slack: int = 8,
                 block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, digest (of the text), item_id, score, end_word: one row for each document row and
    item that align with a score of ``floor`` of an exact copy's, over ``least`` matched words
    (all of a shorter item's). end_word is where the best alignment ends.

    Items of fewer than four words, empty and null ones, are no evidence and match nothing; null
    texts hold nothing; long texts are searched whole, in bounded windows. Repeated rows and items
    give repeated results. Items are taken in blocks
    of about ``block_chars`` characters, which bounds what is collected and broadcast.
    """
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                              F.xxhash64("text").alias("digest"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        words, bounds = word_hashes([r["text"] for r in block])
        index = Index([r["item_id"] for r in block],
                      [words[s:e] for s, e in zip(bounds, bounds[1:], strict=False)])
        keys = np.unique(index.hash)
        if not len(keys):
            continue
        index.choose(document_counts(rows, keys), keys, plain, factor)
        if not len(index.keys):
            continue
        found = _scan(rows, index, floor, least, slack)
        out = found if out is None else out.union(found)
    if out is None:
        return rows.where(F.lit(False)).select(
            "doc_id", "digest", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"),
            F.lit(0).cast("long").alias("end_word"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = contaminated(docs, benchmark, **options).select(
        F.col("doc_id").alias("_doc_id"), F.col("digest").alias("_digest")).distinct()
    whole = Whole(docs)
    on = whole.doc_id.eqNullSafe(bad["_doc_id"]) & (whole.digest == bad["_digest"])
    return whole.back(whole.df.join(bad, on, "left_anti"))
