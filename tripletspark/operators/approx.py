"""Approximate top-k from a stored inverted-cell index, with the exact search as the way out.

The pivots are a bounded sample of the rows, every row is stored in the cell of its nearest pivot:
Parquet, one partition a cell, large cells in several blocks. Beside them stand the pivots with
each cell's rows and radius, and how many cells a search has to open. That number is fitted to
the data: for a bounded sample of rows the exact neighbours are looked up once, and enough cells
are opened to find the wanted share of them. Clustered vectors need a few cells, vectors without
any structure many.

A search opens the nearest cells of each query and reads no other partition. With ``exact`` it goes
on with the cells that the triangle inequality can't rule out against the k-th best score so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.operators.indexing import hash_key
from tripletspark.operators.similarity import (
    BLOCK_ROWS, BROADCAST_BYTES, BROADCAST_ROWS, MAX_PIVOTS, SCAN_SCORES, Cells, _block_in_cell,
    _hit_schema, _hits, _lookup, _with_cell, best_k, join_blocks, meet, mips_topk, select_top,
    to_ids, to_matrix, to_unit,
)
from tripletspark.session import cut_lineage

#: Rows whose exact neighbours are looked up to fit the number of cells to open.
FIT_ROWS = 256


@dataclass(frozen=True)
class CellIndex:
    """A stored index: folder, cells, and how many of them a search opens."""
    path: str
    cells: Cells
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, v, rblk, cell) of all indexed rows; a filter on cell prunes partitions."""
        return spark.read.parquet(f"{self.path}/rows")


def _nearest(unit: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first; of equal ones the first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :n]


def build_index(corpus: DataFrame, path: str, *, id_col: str = "id", vec: str = "embedding",
                cells: int | None = None, k: int = 10, recall: float = 0.95,
                fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS,
                seed: int = 42) -> CellIndex:
    """Store the index of all rows of ``corpus`` in ``path`` and return it.

    ``cells`` pivots, by default twice the root of the number of rows and at most MAX_PIVOTS, are
    the first rows in hash order; so are the ``fit_rows`` rows for which the number of cells to open
    is fitted to reach ``recall`` of the ``k`` nearest others. Ids are unique. A cell of many rows,
    say of copies of one vector, is cut into blocks.
    """
    if not 0 < recall <= 1 or k < 1:
        raise ValueError("recall must be in (0, 1] and k at least 1")
    spark = corpus.sparkSession
    base = corpus.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    n = base.count()
    cells = min(MAX_PIVOTS, cells or math.ceil(2 * math.sqrt(n)))
    first = (base.orderBy(hash_key("id", seed), "id").limit(max(cells, fit_rows)).toArrow())
    pivots = to_unit(to_matrix(first["v"]))[:cells] if n else np.zeros((0, 0))
    if n:
        placed = cut_lineage(_with_cell(base, pivots))
        stats = {s.cell: s for s in placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()}  # a row a cell
        blocks = [-(-stats[c].n // block_rows) if c in stats else 0 for c in range(len(pivots))]
        starts = [0, *np.cumsum(blocks)[:-1].tolist()]
        (placed.withColumn("rblk", _block_in_cell(starts, [max(1, b) for b in blocks], "id"))
         .repartition(max(1, min(sum(blocks), 20_000)), "cell", "rblk")
         .select("id", "v", "rblk", "cell").write.partitionBy("cell").parquet(f"{path}/rows"))
        radius = [stats[c].r if c in stats else 0.0 for c in range(len(pivots))]
        fit = first.slice(0, fit_rows)
        probes = _fitted(base, placed, fit, pivots, k, recall)
    else:
        base.withColumn("rblk", F.lit(0)).withColumn("cell", F.lit(0)).write.parquet(
            f"{path}/rows")
        starts, blocks, radius, probes = [], [], [], 0
    spark.createDataFrame(
        [(c, p.tolist(), r, s, b, probes) for c, (p, r, s, b) in enumerate(zip(
            pivots, map(float, radius), starts, blocks, strict=True))],
        "cell int, pivot array<double>, radius double, first_block int, blocks int, probes int"
    ).coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def _fitted(base: DataFrame, placed: DataFrame, fit: pa.Table, pivots: np.ndarray, k: int,
            recall: float) -> int:
    """How many cells hold the wanted share of the sample's neighbours."""
    asked = base.sparkSession.createDataFrame(fit)
    hits = mips_topk(asked, base, k, query_id="id", doc_id="id", vec="v", exclude_self=True)
    homes = hits.join(placed.select(F.col("id").alias("doc_id"), "cell"), "doc_id").select(
        "query_id", "cell").toArrow()  # fit_rows * k rows
    if not homes.num_rows:
        return 1
    ids = to_ids(fit["id"])
    order = _nearest(to_unit(to_matrix(fit["v"])), pivots, len(pivots))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(pivots))[None, :], axis=1)
    by_id = np.argsort(ids)
    at = by_id[np.searchsorted(ids[by_id], to_ids(homes["query_id"]))]
    ranks = np.sort(place[at, homes["cell"].to_numpy()]) + 1
    return int(ranks[math.ceil(recall * len(ranks)) - 1])


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """An index that ``build_index`` stored; at most MAX_PIVOTS vectors reach the driver."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    pivots = np.array([r.pivot for r in rows]) if rows else np.zeros((0, 0))
    return CellIndex(path, Cells(pivots, np.array([r.radius for r in rows]),
                                 [r.first_block for r in rows], [r.blocks for r in rows]),
                     rows[0].probes if rows else 0)


def approx_topk(queries: DataFrame, index: CellIndex, k: int, *, query_id: str = "query_id",
                vec: str = "embedding", probes: int | None = None, exact: bool = False,
                exclude_self: bool = False, broadcast_rows: int = BROADCAST_ROWS,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows in the ``probes`` nearest cells of each
    query (by default the fitted number), or of all rows with ``exact``.

    Scores are compared at six decimals, ties by doc_id. A query may get fewer than k rows if its
    cells hold fewer.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    stored = index.rows(spark)
    q = queries.select(F.col(query_id).alias("id"), F.col(vec).alias("v"))
    schema = _hit_schema(q.schema["id"].dataType, stored.schema["id"].dataType)
    wanted = min(len(index.cells.pivots), max(1, probes or index.probes))
    if not len(index.cells.pivots):
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select(
            "query_id", "rank", "doc_id", "score")
    probe = q.limit(broadcast_rows + 1).toArrow()
    small = probe.num_rows <= broadcast_rows and probe.nbytes <= BROADCAST_BYTES

    def search(asked: DataFrame, sent: pa.Table | None) -> DataFrame:
        if sent is not None:
            return _by_scan(sent, stored, index, k, schema, exclude_self)
        return _by_blocks(asked, stored, index, k, schema, exclude_self, block_rows)

    opened = _opened(q, index, wanted)
    found = search(opened, opened.toArrow() if small else None)
    if exact:
        found = cut_lineage(found)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        floors = (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
                  .select(F.col("query_id").alias("id"), F.col("score").alias("floor")))
        rest = _opened(q.join(floors, "id", "left").select("id", "v", "floor"), index, wanted,
                       rest=True)
        found = found.unionByName(search(rest, rest.toArrow() if small else None))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def _opened(queries: DataFrame, index: CellIndex, wanted: int, rest: bool = False) -> DataFrame:
    """(id, v, cells): the cells to open for each query: the ``wanted`` nearest, or of the others
    those that may hold a row of at least the score ``floor`` (null: any)."""
    sent = queries.sparkSession.sparkContext.broadcast(index.cells)
    schema = T.StructType([queries.schema["id"], queries.schema["v"],
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        full = np.array(cells.blocks) > 0
        step = max(64, SCAN_SCORES // len(cells.pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit = to_unit(to_matrix(part.column(1)))
                keep = np.zeros((len(unit), len(cells.pivots)), bool)
                np.put_along_axis(keep, _nearest(unit, cells.pivots, wanted), True, axis=1)
                if rest:
                    floor = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    keep = ~keep & (cells.bounds(unit)[1] >= floor[:, None])
                keep &= full
                ends = np.concatenate([[0], keep.sum(axis=1).cumsum()]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.nonzero(keep)[1].astype(np.int32)))],
                    names=["id", "v", "cells"])
    return queries.mapInArrow(choose, schema)


def _by_scan(asked: pa.Table, stored: DataFrame, index: CellIndex, k: int, schema: T.StructType,
             exclude_self: bool) -> DataFrame:
    """The queries are sent to all tasks; only opened partitions are read, nothing is shuffled but
    the best k of each task."""
    lists = asked["cells"].to_pylist()
    used = sorted({c for x in lists for c in x})
    asking = {c: [] for c in used}
    for row, found in enumerate(lists):
        for c in found:
            asking[c].append(row)
    asking = {c: np.array(x) for c, x in asking.items()}
    sent = stored.sparkSession.sparkContext.broadcast(
        (to_ids(asked["id"]), to_unit(to_matrix(asked["v"])), asking))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by_cell = sent.value
        row, docs, score = np.zeros(0, np.int64), None, np.zeros(0)
        floor = np.full(len(ids), -np.inf)
        for batch in batches:
            of = batch.column(2).to_numpy()
            for cell in np.unique(of):
                rows = by_cell[int(cell)]
                part = batch.filter(pa.array(of == cell))
                step = max(64, SCAN_SCORES // len(rows))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    d = to_ids(some.column(0))
                    cosines = q[rows] @ to_unit(to_matrix(some.column(1))).T
                    r, j, s = select_top(cosines, ids[rows], d, k, floor[rows], exclude_self)
                    row = np.concatenate([row, rows[r]])
                    docs = d[j] if docs is None else np.concatenate([docs, d[j]])
                    score = np.concatenate([score, s])
            if docs is not None:
                top = best_k(row, docs, score, k)
                row, docs, score = row[top], docs[top], score[top]
                full = np.bincount(row, minlength=len(ids)) >= k
                lowest = np.full(len(ids), np.inf)
                np.minimum.at(lowest, row, score)
                floor = np.where(full, lowest, -np.inf)
        if docs is not None and len(row):
            yield _hits(ids[row], docs, score, schema).to_batches()[0]
    if not used:
        return stored.sparkSession.createDataFrame([], schema)
    return (stored.filter(F.col("cell").isin(used)).select("id", "v", "cell")
            .mapInArrow(scan, schema))


def _by_blocks(opened: DataFrame, stored: DataFrame, index: CellIndex, k: int,
               schema: T.StructType, exclude_self: bool, block_rows: int) -> DataFrame:
    """Many queries: those of a cell, in chunks of bounded size, meet the cell's blocks. Cells are
    chosen in narrow rows; the vectors follow to each chunk."""
    opened = cut_lineage(opened)
    routes = opened.select("id", F.explode("cells").alias("cell"))
    counts = {r.cell: r.n for r in routes.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    if not counts:
        return opened.sparkSession.createDataFrame([], schema)
    cells = index.cells
    chunks = [max(1, -(-counts.get(c, 0) // block_rows)) for c in range(len(cells.blocks))]
    first = [0, *np.cumsum(chunks)[:-1].tolist()]
    start, blocks = _lookup(cells.first_block), _lookup(cells.blocks)
    routes = (routes.withColumn("lblk", _block_in_cell(first, chunks, "id"))
              .withColumn("rblk", F.explode(F.sequence(start, start + blocks - 1))))
    left = routes.select("id", "lblk", "rblk").join(opened.select("id", "v"), "id")
    right = stored.filter(F.col("cell").isin(sorted(counts))).select("id", "v", "rblk")

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        qi, di = to_ids(lt["id"]), to_ids(rt["id"])
        cosines = to_unit(to_matrix(lt["v"])) @ to_unit(to_matrix(rt["v"])).T
        r, j, s = select_top(cosines, qi, di, k, np.full(len(qi), -np.inf), exclude_self)
        return _hits(qi[r], di[j], s, schema)
    return join_blocks(*meet(left, right), kernel, schema)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_queries, wanted, found, recall: how much of an exact top-k an approximate one holds."""
    hit = F.col("f").isNotNull()
    both = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("f")),
                      ["query_id", "doc_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"),
                    F.count(F.lit(1)).alias("wanted"), F.count_if(hit).alias("found"),
                    F.avg(hit.cast("double")).alias("recall"))
