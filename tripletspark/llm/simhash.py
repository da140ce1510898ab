"""SimHash near duplicates with pigeonring filtering.

A fingerprint is a ring of eight byte segments. If two differ in at most t bits, some segment
starts a chain on which, for every length l, the first l segments differ in at most t * l / 8
bits. Where that budget is zero the segments are equal; over the next segments, with a budget
of one, all parts but one are equal. These equal bits are the key of an exact join; what shares
a key is held against the whole chain, and only then against the full Hamming distance.

Distinct fingerprints only enter the join. Groups under a key that grow beyond ``GROUP`` are
not compared but split: of t + 1 parts of the bits that are still free one is equal, and the
free bits run out before the groups can be large. So no key's group has to fit one task, and
only links that join something new leave a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.llm.components import components
from tripletspark.llm.tables import Whole, texts
from tripletspark.session import broadcast_if_small, cut_lineage

SEGMENTS = 8
SEED = 42
GROUP = 4096
SMALL = 32
_ALL = (1 << 64) - 1


def budgets(bits: int) -> list[int]:
    """The differing bits that a chain of 1, 2, ... segments may have."""
    return [bits * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def key_masks(bits: int) -> list[int]:
    """Masks over a fingerprint turned to its chain's start: the bits that are equal for sure."""
    allowed = budgets(bits)
    zero, one = 8 * allowed.count(0), 8 * allowed.count(1)
    head = (_ALL << (64 - zero)) & _ALL
    if not one:
        return [head]
    edges = np.linspace(zero, zero + one, 4 if one >= 24 else 5).astype(int).tolist()
    left_out = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:], strict=False)]
    span = ((1 << one) - 1) << (64 - zero - one)
    return [head | (span & ~m) for m in left_out]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, width: int) -> bytes:
    """Eight bytes, the most significant bit first."""
    found = text.encode().lower().split()
    if not found:
        return bytes(8)
    shingles = (map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))
                if len(found) >= width else [b" ".join(found)])
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        block = h[i:i + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, digest (of the text), fp (the fingerprint as a signed long), one row per row.

    Words are runs without ASCII white space, A-Z lower-cased; no words, or null: zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t, width) for t in batch.column("text").to_pylist())
            fps = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(fps)],
                names=["doc_id", "digest", "fp"])
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                              F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest long, fp long")


def _turned(fp: Column, k: int) -> Column:
    """The fingerprint rotated so that segment k comes first."""
    return fp if not k else F.shiftleft(fp, 8 * k).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * k))


_ROW = "turn int, part long, free long, key long, fp long"


def _keyed(distinct: DataFrame, bits: int) -> DataFrame:
    """A row for each key of a fingerprint (turned to the chain's start): turn, part (which
    bits the key has), free (the others) and key."""
    masks, rows = key_masks(bits), []
    for k in range(SEGMENTS):
        fp = _turned(F.col("fp"), k)
        rows += [F.struct(F.lit(k).alias("turn"), F.lit(k * len(masks) + j).cast("long")
                          .alias("part"), F.lit(signed(~m & _ALL)).cast("long").alias("free"),
                          fp.bitwiseAND(F.lit(signed(m)).cast("long")).alias("key"),
                          fp.alias("fp")) for j, m in enumerate(masks)]
    return distinct.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _split(rows: DataFrame, level: int, parts: int) -> DataFrame:
    """Keys with one more part of the free bits in each, by one expression over ``free``. The
    places are dealt to the parts anew on each level, so a part without free bits, which leaves
    its key as it was, gets some on the next."""
    places = np.random.default_rng(level).permutation(64)
    new = []
    for j, run in enumerate(np.array_split(places, parts)):
        part = F.lit(signed(sum(1 << int(p) for p in run))).cast("long")
        taken = F.col("free").bitwiseAND(part)
        free = F.col("free").bitwiseAND(F.bitwise_not(part))
        new.append(F.struct("turn", (F.col("part") * parts + j).alias("part"), free.alias("free"),
                            F.col("key").bitwiseOR(F.col("fp").bitwiseAND(taken)).alias("key"),
                            "fp"))
    return rows.select(F.explode(F.array(*new)).alias("x")).select("x.*")


def chain_holds(x: np.ndarray, bits: int) -> np.ndarray:
    """Which differences (turned to their start) keep every budget of the chain, then the full
    distance; each length is looked at only where the shorter ones held."""
    held = np.arange(len(x))
    for n, most in enumerate(budgets(bits), start=1):
        held = held[np.bitwise_count(x[held] >> np.uint64(64 - 8 * n)) <= most]
    return held


def _spanning(fps: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links of a group that join something new; memory and links grow with the group only."""
    label = np.arange(len(fps))
    for i in range(len(fps) - 1):
        near = i + 1 + chain_holds(fps[i + 1:] ^ fps[i], bits)
        near = near[label[near] != label[i]]
        others, first = np.unique(label[near], return_index=True)
        for j in near[first]:
            yield i, j
        if len(others):
            label[np.isin(label, others)] = label[i]


def _back(fp: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Turned fingerprints as they were."""
    k = (8 * turn).astype(np.uint64)
    up = (np.uint64(64) - k) % np.uint64(64)
    return ((fp >> k) | np.where(k > 0, fp << up, np.uint64(0))).view(np.int64)


def _compare(bits: int, small: int):
    """Over rows sorted by (part, key): the links inside each run of equal keys."""
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        part, key = rows["part"].to_numpy(), rows["key"].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(part)])
        size = np.repeat(sizes, sizes)
        room = np.repeat(starts + sizes, sizes) - np.arange(len(part))
        left, right = [], []
        for d in range(1, small):
            at = np.flatnonzero((size <= small) & (room > d))
            if not len(at):
                break
            at = at[chain_holds(fp[at] ^ fp[at + d], bits)]
            left.append(at)
            right.append(at + d)
        for s, n in zip(starts, sizes, strict=True):
            if n > small:
                found = np.array([*_spanning(fp[s:s + n], bits)], np.int64).reshape(-1, 2)
                left.append(s + found[:, 0])
                right.append(s + found[:, 1])
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
                for x in (left, right))
        turn = rows["turn"].to_numpy()
        return pd.DataFrame({"a": _back(fp[a], turn[a]), "b": _back(fp[b], turn[b])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last run so far, of bounded size
        for frame in frames:
            if not len(frame):
                continue
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = rows.iloc[-1]
            tail = ((rows["part"] == last["part"]) & (rows["key"] == last["key"])).to_numpy()
            held = rows[tail]
            if not tail.all():
                yield links(rows[~tail])
        if held is not None:
            yield links(held)
    return run


def hamming_links(distinct: DataFrame, bits: int, group: int = GROUP,
                  small: int = SMALL) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) of at most ``bits`` differing bits
    that join everything that such links join (of a large group, a spanning part).

    Keys of more than ``group`` rows, counted by an aggregate, are split by further bits; only
    the others' rows are brought together. Groups of ``small`` are compared pair by pair."""
    rows, found, level = _keyed(distinct, bits), None, 0
    while True:
        large = cut_lineage(rows.groupBy("part", "key").agg(F.count("*").alias("n"))
                            .where(F.col("n") > group).select("part", "key"))
        some = not large.isEmpty()
        large = broadcast_if_small(large)
        rest = rows.join(large, ["part", "key"], "left_anti") if some else rows
        of = Window.partitionBy("part", "key")
        shared = rest.withColumn("n", F.count("*").over(of)).where(F.col("n") > 1)
        links = cut_lineage(shared.select("turn", "part", "key", "fp")
                            .mapInPandas(_compare(bits, small), "a long, b long"))
        found = links if found is None else found.union(links)
        if not some:
            return found
        over = rows.join(large, ["part", "key"], "left_semi")
        rows, level = cut_lineage(_split(over, level, bits + 1)), level + 1


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of the text), fingerprint (16 hex digits),
    root (of its component) and component_id, the smallest doc_id that links of at most ``bits``
    differing bits reach.

    Equal texts have equal fingerprints and meet there, without pairs. Null and empty texts
    have the fingerprint zero, which links as any other. A null doc_id never gives its name to
    a component unless all its documents have none. No documents: no rows.
    """
    marked = cut_lineage(fingerprints(docs, width))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(hamming_links(distinct.select("fp"), bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(named)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(best, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "digest", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root",
        "component_id")


def keep_first(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with one document of each root in ``marked`` (doc_id, digest, root)."""
    stay = marked.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("x")).select(
        F.col("x.doc_id").alias("_doc_id"), F.col("x.digest").alias("_digest"))
    whole = Whole(docs)
    own = whole.df.withColumn("_own", whole.digest).withColumn("_id", whole.doc_id)
    on = own["_id"].eqNullSafe(stay["_doc_id"]) & (own["_own"] == stay["_digest"])
    return whole.back(own.join(stay, on, "left_semi").dropDuplicates(["_id", "_own"]))


def drop_near_duplicates(docs: DataFrame, width: int = 5, bits: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id, of repeated
    rows any one."""
    return keep_first(docs, near_duplicates(docs, width, bits))
