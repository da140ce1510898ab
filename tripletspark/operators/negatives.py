"""Hard and hybrid negative mining by similarity band."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.functions.vectors import sanitize_vectors
from tripletspark.operators.indexing import dense_index
from tripletspark.operators.metrics import similarity_stats
from tripletspark.operators.quality import drop_legacy
from tripletspark.operators.sampling import first_offset, random_partners
from tripletspark.operators.similarity import (
    DECIMALS, all_blocks, best_k, block_of, chunk_queries, join_blocks, meet, place_in_blocks,
    route, stored_cells, to_matrix, to_unit,
)
from tripletspark.session import cut_lineage

BLOCK_ROWS = 1024  # a task of the first phase holds PREFIX_BLOCKS of them against one
PREFIX_BLOCKS = 4


def _candidate_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("id", id_type), T.StructField("neg_id", id_type),
        T.StructField("kind", T.StringType()), T.StructField("key", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ])


def _take(table: pa.Table, name: str, rows: np.ndarray) -> pa.ChunkedArray:
    return table[name].take(pa.array(rows, pa.int64()))


def _walk_step(a: np.ndarray, start: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """At which step of its walk row a meets row b (elementwise)."""
    return ((b - a - 1) % n - start) % max(n - 1, 1)


def _first_met(band: np.ndarray, lt: pa.Table, b: np.ndarray, n: int, size: int):
    """(row, column, step) of the first n band members per row on its walk."""
    r, c = np.nonzero(band)
    key = _walk_step(lt["a"].to_numpy()[r], lt["start"].to_numpy()[r], b[c], size)
    top = best_k(r, b[c], -key, n)
    return r[top], c[top], key[top]


def _least_similar(s: np.ndarray, valid: np.ndarray, b: np.ndarray, n: int):
    """(row, column) of the n smallest valid similarities per row, ties by index."""
    score = np.where(valid, s, np.inf)
    cut = (np.partition(score, n - 1, axis=1)[:, n - 1] if score.shape[1] > n
           else np.full(len(score), np.inf))
    r, c = np.nonzero((score <= cut[:, None]) & valid)
    top = best_k(r, b[c], -score[r, c], n)
    return r[top], c[top]


def hard_negatives(df: DataFrame, n: int, lo: float = 0.2, hi: float = 0.4, seed: int = 42, *,
                   id_col: str = "id", vec: str = "embedding", strict_fill: bool = True,
                   block_rows: int = BLOCK_ROWS, prefix_blocks: int = PREFIX_BLOCKS) -> DataFrame:
    """(id, rank, neg_id, score, source): up to n negatives per row from the band
    lo <= cosine <= hi (six decimals).

    Let R be the other rows in the band and V those with cosine >= 0 outside it.
    |R| >= n: n random rows of R. 0 < |R| < n: all of R, then the n - |R| least similar of V
    if V has that many (``strict_fill``), else none; with ``strict_fill=False`` as many as
    V has. R empty: up to n least similar of V.

    "Random" is a walk: each row visits all others in its own cyclic pseudo-random order
    and takes the first n it meets in the band, which is a uniform choice from R. Most rows
    are done after a few blocks, so the first phase compares a row with ``prefix_blocks``
    blocks only, at linear cost. Rows that have not found n by then meet, in the second phase,
    the cells (rows around a pivot) whose cosines can lie in the band. For the least similar a
    threshold search follows: the n-th least similar so far rules out every cell whose smallest
    possible cosine is larger. Candidate lists are bounded.
    The result is the same for any block size and any prefix.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    base = df.select(F.col(id_col).alias("id"), sanitize_vectors(vec).alias("v"))
    size = base.count()
    blocks = max(1, -(-size // block_rows))
    indexed = (dense_index(base, "id", seed=seed, out="a")
               .withColumn("blk", F.floor(F.col("a") / block_rows).cast("int"))
               .withColumn("start", first_offset(F.col("a"), F.lit(size), seed)))
    schema = _candidate_schema(base.schema["id"].dataType)
    if blocks <= prefix_blocks + 1:
        chosen = _full_scan(indexed, indexed, size, blocks, size, n, lo, hi, schema,
                            strict_fill, block_rows)
    else:
        indexed = cut_lineage(indexed)
        met = cut_lineage(_prefix_scan(indexed, size, blocks, n, lo, hi, schema, prefix_blocks,
                                       block_rows))
        done = met.filter("found >= " + str(n)).select("id").distinct()
        picked = met.filter(F.col("found") >= n).select(
            "id", "neg_id", "score", F.lit("in_range").alias("source"),
            F.col("pos").alias("rank"))
        open_rows = indexed.join(done, "id", "left_anti")
        chosen = picked if open_rows.isEmpty() else picked.unionByName(_bounded_scan(
            open_rows, indexed, size, n, lo, hi, schema, strict_fill, block_rows))
    return chosen.select(F.col("id").alias(id_col), "rank", "neg_id", "score", "source")


def _prefix_scan(indexed: DataFrame, size: int, blocks: int, n: int, lo: float, hi: float,
                 schema: T.StructType, prefix_blocks: int, block_rows: int) -> DataFrame:
    """The first n band members met within the first blocks of each row's walk."""
    first = ((F.col("a") + 1 + F.col("start")) % size)
    left = (indexed.withColumn("first", first)
            .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(prefix_blocks - 1))))
            .withColumn("rblk", ((F.floor(F.col("first") / block_rows) + F.col("t")) % blocks)
                        .cast("int"))
            .withColumn("lblk", F.lit(0)).drop("blk"))
    right = indexed.withColumn("rblk", F.col("blk")).withColumn("lblk", F.lit(0))

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        a, b = lt["a"].to_numpy(), rt["a"].to_numpy()
        s = np.round(to_unit(to_matrix(lt["v"])) @ to_unit(to_matrix(rt["v"])).T, DECIMALS)
        wanted = (s >= lo) & (s <= hi) & (a[:, None] != b[None, :])
        # In the block where the walk starts, rows before the start belong to its very end.
        wanted &= (lt["t"].to_numpy() > 0)[:, None] | (b[None, :] >= lt["first"].to_numpy()[:, None])
        r, c, key = _first_met(wanted, lt, b, n, size)
        return pa.Table.from_arrays([
            _take(lt, "id", r), _take(rt, "id", c), pa.array(["R"] * len(r), pa.string()),
            pa.array(key, pa.int64()), pa.array(s[r, c]),
        ], names=schema.names)

    met = join_blocks(left, right, kernel, schema)
    per_row = Window.partitionBy("id")
    return (met.withColumn("pos", F.row_number().over(per_row.orderBy("key")))
            .filter(F.col("pos") <= n)
            .withColumn("found", F.count(F.lit(1)).over(per_row))
            .select("id", "neg_id", "score", "pos", "found"))


def _kernel(size: int, n: int, lo: float, hi: float, schema: T.StructType, with_band: bool):
    """Of two blocks: the n first of R on each row's walk and its n least similar of V."""
    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        a, b = lt["a"].to_numpy(), rt["a"].to_numpy()
        s = np.round(to_unit(to_matrix(lt["v"])) @ to_unit(to_matrix(rt["v"])).T, DECIMALS)
        other = a[:, None] != b[None, :]
        in_range = (s >= lo) & (s <= hi) & other
        valid = (s >= 0) & ~in_range & other
        r1, c1, key = _first_met(in_range if with_band else in_range & False, lt, b, n, size)
        r2, c2 = _least_similar(s, valid, b, n)
        rows, cols = np.concatenate([r1, r2]), np.concatenate([c1, c2])
        return pa.Table.from_arrays([
            _take(lt, "id", rows), _take(rt, "id", cols),
            pa.array(["R"] * len(r1) + ["V"] * len(r2), pa.string()),
            pa.array(np.concatenate([key, b[c2]]), pa.int64()),
            pa.array(s[rows, cols])], names=schema.names)
    return run


def _full_scan(open_rows: DataFrame, indexed: DataFrame, size: int, blocks: int, n_open: int,
               n: int, lo: float, hi: float, schema: T.StructType, strict_fill: bool,
               block_rows: int) -> DataFrame:
    """All blocks (a few) for the given rows."""
    chunks = max(1, -(-n_open // block_rows))
    left = (open_rows.withColumn("lblk", block_of("a", chunks))
            .withColumn("rblk", all_blocks(blocks)).drop("blk"))
    right = (indexed.withColumn("rblk", F.col("blk")).withColumn("lblk", all_blocks(chunks))
             .drop("blk"))
    found = join_blocks(left, right, _kernel(size, n, lo, hi, schema, True), schema)
    return _decided(found, n, strict_fill)


def _bounded_scan(open_rows: DataFrame, indexed: DataFrame, size: int, n: int, lo: float,
                  hi: float, schema: T.StructType, strict_fill: bool,
                  block_rows: int) -> DataFrame:
    """The cells that can matter to the given rows, in two rounds.

    First each row meets the cells whose bounds meet the band, so R is complete, and the cell
    that may hold the least similar rows. Its n-th least similar so far is a bound on what is
    still wanted of V; only rows with too small an R meet further cells, those whose smallest
    possible cosine is within the bound."""
    rows = indexed.select("id", "v", "a", "start")
    cells, placed = stored_cells(rows, block_rows)
    right = place_in_blocks(placed, cells, "rblk").select("id", "v", "a", "rblk")
    left = chunk_queries(open_rows.select("id", "v", "a", "start"), cells, block_rows)

    def first(low: np.ndarray, high: np.ndarray, _) -> np.ndarray:
        wanted = (high >= lo) & (low <= hi)
        least = np.where(high >= 0, np.maximum(low, 0), np.inf).argmin(axis=1)
        wanted[np.arange(len(wanted)), least] = True
        return wanted

    def rest(low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return ~first(low, high, bound) & (high >= 0) & (np.maximum(low, 0) <= bound)

    routed = route(left.withColumn("floor", F.lit(0.0)), cells, first)
    found = cut_lineage(join_blocks(*meet(routed, right), _kernel(size, n, lo, hi, schema, True),
                                    schema))
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("score", "key"))
    so_far = (found.withColumn("_p", place).groupBy("id")
              .agg(F.count_if(F.col("kind") == "R").alias("_r"),
                   F.max(F.when((F.col("kind") == "V") & (F.col("_p") == n), F.col("score")))
                   .alias("_bound")))
    short = (left.join(so_far, "id", "left").filter(F.coalesce("_r", F.lit(0)) < n)
             .withColumn("floor", F.coalesce("_bound", F.lit(float("inf")))).drop("_r", "_bound"))
    more = join_blocks(*meet(route(short.select(*left.columns, "floor"), cells, rest), right),
                       _kernel(size, n, lo, hi, schema, False), schema)
    return _decided(found.unionByName(more), n, strict_fill)


def _decided(found: DataFrame, n: int, strict_fill: bool) -> DataFrame:
    """The choice from candidate lists that hold the first n of R and of V of each row."""
    order = Window.partitionBy("id", "kind").orderBy(
        F.when(F.col("kind") == "V", F.col("score")).otherwise(0.0), "key")
    per_row = Window.partitionBy("id")
    # n of each kind decide: min(|R|, n) and min(|V|, n) are all the cases depend on.
    ranked = (found.withColumn("_pos", F.row_number().over(order)).filter(F.col("_pos") <= n)
              .withColumn("_r", F.count_if(F.col("kind") == "R").over(per_row))
              .withColumn("_v", F.count_if(F.col("kind") == "V").over(per_row)))
    need = F.greatest(F.lit(n) - F.col("_r"), F.lit(0))
    may_fill = (F.col("_r") == 0) | (F.col("_v") >= need) | F.lit(not strict_fill)
    from_band = F.col("kind") == "R"
    fill = (F.col("kind") == "V") & may_fill & (F.col("_pos") <= need)
    return (ranked.filter(from_band | fill)
            .select("id", "neg_id", "score",
                    F.when(F.col("kind") == "R", "in_range").otherwise("fallback")
                    .alias("source"),
                    F.when(F.col("kind") == "R", F.col("_pos"))
                    .otherwise(F.col("_pos") + F.col("_r")).cast("int").alias("rank")))


def hybrid_negative_ids(df: DataFrame, total: int = 5, hard: int = 2, lo: float = 0.2,
                        hi: float = 0.4, seed: int = 42, *, id_col: str = "id",
                        vec: str = "embedding", **options) -> DataFrame:
    """(id, kind, rank, neg_id): hard picks first, then total - hard random other rows
    that are not among the hard picks."""
    if not 0 <= hard <= total:
        raise ValueError("need 0 <= hard <= total")
    if not 0 <= lo < hi <= 1:
        raise ValueError("need 0 <= lo < hi <= 1")
    if total < 1:
        raise ValueError("total must be at least 1")
    drawn = random_partners(df, id_col, total, seed)
    if hard == 0:
        easy = drawn
        mined = None
    else:
        mined = hard_negatives(df, hard, lo, hi, seed, id_col=id_col, vec=vec, **options)
        easy = drawn.join(mined.select(id_col, "neg_id"), [id_col, "neg_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    easy = (easy.withColumn("rank", place).filter(F.col("rank") <= total - hard)
            .select(id_col, F.lit("easy").alias("kind"), "rank", "neg_id"))
    if mined is None:
        return easy
    return mined.select(id_col, F.lit("hard").alias("kind"), "rank", "neg_id").unionByName(easy)


def hybrid_negatives(df: DataFrame, text_col: str, total: int = 5, hard: int = 2,
                     lo: float = 0.2, hi: float = 0.4, seed: int = 42, *,
                     id_col: str = "id", vec: str = "embedding", **options) -> DataFrame:
    """Attach ``negative_feedbacks`` (hard first) and ``negatives_metadata``; the old
    single-negative columns go."""
    ids = hybrid_negative_ids(df, total, hard, lo, hi, seed, id_col=id_col, vec=vec, **options)
    texts = df.select(F.col(id_col).alias("neg_id"), F.col(text_col).alias("_text"))
    hard_first = F.when(F.col("kind") == "hard", 0).otherwise(1)
    lists = (ids.join(texts, "neg_id").groupBy(id_col)
             .agg(F.array_sort(F.collect_list(F.struct(hard_first.alias("k"), "rank", "_text")))
                  .alias("_l"),
                  F.count_if(F.col("kind") == "hard").cast("int").alias("_h")))
    found = F.coalesce(F.size("_l"), F.lit(0))
    n_hard = F.coalesce("_h", F.lit(0))
    rows = drop_legacy(df.drop("negative_feedbacks", "negatives_metadata"))
    return (rows.join(lists, id_col, "left")
            .withColumn("negative_feedbacks", F.coalesce(
                F.transform("_l", lambda s: s["_text"]), F.array().cast("array<string>")))
            .withColumn("negatives_metadata", F.struct(
                F.when(F.col("_l").isNull(), 0).otherwise(found).alias("total"),
                n_hard.alias("num_hard"),
                F.when(F.col("_l").isNull(), 0).otherwise(found - n_hard).alias("num_easy"),
                F.lit("hybrid").alias("generation_method")))
            .drop("_l", "_h"))


def mining_report(mined: DataFrame, n_rows: DataFrame, n: int) -> DataFrame:
    """Found in range (count and percentage of n per row), fallbacks, and statistics of
    the chosen similarities. ``n_rows`` is the mined table, counted once."""
    counts = mined.agg(
        F.struct(F.count_if(F.col("source") == "in_range").alias("found"),
                 F.count_if(F.col("source") == "fallback").alias("fallback")).alias("c"))
    total = n_rows.agg(F.count(F.lit(1)).alias("n"))
    stats = similarity_stats(mined, "score")
    return (stats.withColumn("_c", counts.scalar()).withColumn("_n", total.scalar())
            .select(F.col("_n").alias("n_examples"),
                    F.col("_c.found").alias("n_in_range"),
                    F.try_divide(100.0 * F.col("_c.found"), F.col("_n") * n)
                    .alias("pct_in_range"),
                    F.col("_c.fallback").alias("n_fallback"),
                    "mean", "median", "min", "max", "std"))
