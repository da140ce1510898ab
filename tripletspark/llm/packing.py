"""Best-fit packing of token sequences, by hierarchical residual packing.

Every scan partition tokenizes its texts and packs its pieces best-fit, longest first. Bins that
are nearly full are finished. Underfull bins go on as items: groups of partitions pool them and
pack them best-fit again, round by round up a tree, until one group is left. A round's rows are
mostly a few bins a partition, but where documents of little more than half a sequence abound, all
their bins go up: groups are counted first, and one of too many bins is dealt to several tasks.
The pieces themselves are never shuffled, they follow their bin through one small join a round.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import texts
from tripletspark.session import broadcast_if_small, cut_lineage

CAPACITY = 1024
END_ID = 2
#: Bins are numbered partition * PER_PARTITION + number.
PER_PARTITION = 1 << 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"


class PieceCache(dict):
    """From a chunk of text (a blank and what follows up to the next) to its ids as bytes.

    The tokenizer never joins what stands before a blank that follows a non-blank with what
    stands after it, so a text's ids are its chunks' ids. Chunks repeat, so most need one look-up.
    The cache is emptied at ``limit`` chunks. Plain chunks go through tiktoken, which holds the
    same vocabulary and merges and starts faster; all others through tokenizers.
    """

    def __init__(self, name: str, limit: int = 800_000):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.limit = limit

    def __missing__(self, chunk: str) -> bytes:
        # Of letters and marks up to Latin Extended-B both libraries think alike; chunks that
        # could hold a special token, a rarer blank or another script go to the full one.
        if "|>" in chunk or _RARE.search(chunk):
            ids = self.full.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self.plain(chunk)
        if len(self) >= self.limit:
            self.clear()
        out = self[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        first, *rest = text.split(" ")
        chunks = [first, *[f" {c}" for c in rest]] if first else [f" {c}" for c in rest]
        if _BLANKS.search(text):
            chunks = _joined(chunks)
        return b"".join(map(self.__getitem__, chunks))


@functools.cache
def piece_cache(name: str) -> PieceCache:
    """The cache of this Python worker, which serves one task after the other."""
    return PieceCache(name)


#: A blank after white space: no place to cut.
_BLANKS = re.compile(r"\s ")
_RARE = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")


def _joined(chunks: list[str]) -> Iterator[str]:
    """Chunks that end in white space go with the next one."""
    held = ""
    for c in chunks:
        if held and not held[-1].isspace():
            yield held
            held = c
        else:
            held += c
    if held:
        yield held


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: whole if it fits, else full pieces after a
    first one that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of every item, and the bins' fill; longest items first, each into the
    fullest bin that takes it."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms: list[int] = []  # sorted free rooms that some bin has
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            b, room = len(fill), capacity
            fill.append(0)
        else:
            room = rooms[k]
            b = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(k)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            if not open_at[left]:
                bisect.insort(rooms, left)
            open_at[left].append(b)
    return bins, places, np.array(fill, np.int64)


def _tokenize_and_pack(name: str, capacity: int, end_id: int, most: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = piece_cache(name)
        base = TaskContext.get().partitionId() * PER_PARTITION
        rows: list[tuple] = []

        def packed() -> pd.DataFrame:
            nonlocal base
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            b, at, fill = best_fit(out["length"].to_numpy(np.int64), capacity)
            out["bin"], out["at"] = base + b, at
            base += len(fill)
            rows.clear()
            return out
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = cache.ids(text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * s:4 * (s + n)])
                    rows.append((None if pd.isna(doc_id) else int(doc_id), k, s, n, crc))
            if len(rows) >= most:
                yield packed()
        if rows:
            yield packed()
    return run


def _merge_round(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ignore_index=True)
        b, at, _ = best_fit(group["fill"].to_numpy(np.int64), capacity)
        # A merged bin takes the number of the first of its bins.
        heads = group["bin"].groupby(b).transform("min")
        return pd.DataFrame({"bin": group["bin"], "into": heads, "shift": at,
                             "fill": group["fill"]})
    return run


def _dealt(pooled: DataFrame, most: int) -> DataFrame:
    """Bins with the part of their group that they are merged in."""
    large = cut_lineage(pooled.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most)
                        .select("g", F.ceil(F.col("n") / most).alias("parts")))
    if large.isEmpty():
        return pooled.withColumn("part", F.lit(0))
    parts = F.coalesce("parts", F.lit(1))
    return pooled.join(broadcast_if_small(large), "g", "left").select(
        "g", "bin", "fill", F.pmod(F.xxhash64("bin"), parts).alias("part"))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY,
         end_id: int = END_ID, slack: float = 0.01, fan_in: int = 8,
         most: int = 200_000, merge_most: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only documents over ``capacity`` are cut. A partition
    packs ``most`` pieces at a time, which bounds its memory. Round r of the tree (r = 0 in the
    scan) finishes the bins filled to 1 - ``slack`` * 4**r, and from half full on at last; the
    others go on as items. ``fan_in`` groups meet in each round, at most about ``merge_most`` bins
    in one task: a larger group is dealt out by the bins' hashes, at the cost of a few sequences
    a task. Long texts are encoded whole. Null and empty
    texts: one piece that holds the end id. Null doc_ids and repeated rows are packed as any
    other. No documents: no rows.
    """
    df = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut_lineage(df.mapInPandas(_tokenize_and_pack(tokenizer, capacity, end_id, most),
                                        PIECES))
    parts = (pieces.agg(F.max("bin")).first()[0] or 0) // PER_PARTITION + 1
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    placed = None  # from a scan's bin to its bin and place so far
    level, width = 0, 1
    while width < parts or not level:
        bins = bins.where(F.col("fill") < capacity * (1 - min(0.5, slack * 4 ** level)))
        level, width = level + 1, width * fan_in
        pooled = cut_lineage(bins.withColumn("g", F.floor(F.col("bin") / PER_PARTITION / width)))
        moved = cut_lineage(
            _dealt(pooled, merge_most).groupBy("g", "part")
            .applyInPandas(_merge_round(capacity), "bin long, into long, shift long, fill long"))
        step = moved.select("bin", "into", "shift")
        if placed is None:
            placed = step
        else:
            on = step.select(F.col("bin").alias("into"), F.col("into").alias("to"),
                             F.col("shift").alias("more"))
            placed = placed.join(on, "into", "left").select(
                "bin", F.coalesce("to", "into").alias("into"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        bins = moved.groupBy(F.col("into").alias("bin")).agg(F.sum("fill").alias("fill"))
    return pieces.join(placed, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
