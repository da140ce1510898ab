"""Exact similarity search and all-pairs statistics.

Two physical shapes. When the query side is proven small it is broadcast and the corpus is
scanned once where it lies. Otherwise both sides are cut into blocks of bounded size, a block
meets only the blocks that bounds on the cosine cannot rule out, through an equi-join, and a
task multiplies two blocks and emits only bounded results: top-k lists, counts per row or a
histogram, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.operators.indexing import hash_key
from tripletspark.session import cut_lineage

BLOCK_ROWS = 2048
BROADCAST_ROWS = 4096
BROADCAST_BYTES = 64 << 20
SCAN_SCORES = 4 << 20  # cosines held at a time while a task scans rows
SET_BYTES = 64 << 20  # of a corpus that a task holds
DECIMALS = 6  # similarities are compared and reported at this precision
_HALF_STEP = 1e-6  # rounding moves a value, and its rival, by half of this


# ---------------------------------------------------------------- helpers inside tasks

def to_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column -> float64 matrix, NaN and infinities as 0. All vectors must have one length.

    Every search and statistic reads its vectors here, so one bad element can't spoil a bound
    or another row's result."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], column.type)
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    flat = np.asarray(arr.flatten(), dtype=np.float64)
    if arr.null_count or flat.size % n:
        raise ValueError("vectors must not be null and must share one length")
    return np.nan_to_num(flat, nan=0.0, posinf=0.0, neginf=0.0).reshape(n, -1)


def to_unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def to_ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as a sortable numpy array (integers or fixed-width text)."""
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) \
        else column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def best_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries per row: score descending, then id ascending."""
    order = np.lexsort((ids, -score, row))
    sorted_row = row[order]
    first = np.searchsorted(sorted_row, sorted_row, side="left")
    return order[np.arange(len(order)) - first < k]


def select_top(cosines: np.ndarray, query_ids: np.ndarray, doc_ids: np.ndarray, k: int,
               floor: np.ndarray, exclude_self: bool):
    """(row, column, score) of the k best documents per row with score >= floor, scores at
    six decimals. Only entries that can be among them are rounded and sorted."""
    cut = floor - _HALF_STEP
    open_rows = np.nonzero(np.isneginf(floor))[0]
    wanted = k + 1 if exclude_self else k
    if len(open_rows) and cosines.shape[1] > wanted:
        cut[open_rows] = np.partition(cosines[open_rows], -wanted, axis=1)[:, -wanted] - _HALF_STEP
    r, c = np.nonzero(cosines >= cut[:, None])
    score = np.round(cosines[r, c], DECIMALS)
    keep = score >= floor[r]
    if exclude_self:
        keep &= query_ids[r] != doc_ids[c]
    r, c, score = r[keep], c[keep], score[keep]
    top = best_k(r, doc_ids[c], score, k)
    return r[top], c[top], score[top]


# ------------------------------------------------------------------------ block layout

def block_count(df: DataFrame, block_rows: int) -> int:
    return max(1, -(-df.count() // block_rows))


def block_of(id_col: Column | str, blocks: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def all_blocks(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def join_blocks(left: DataFrame, right: DataFrame, kernel: Callable, schema: T.StructType
                ) -> DataFrame:
    """Run ``kernel(left rows, right rows)`` for each pair (lblk, rblk) present on both
    sides. Each side of a pair holds one block of bounded size."""
    def run(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        if left_table.num_rows == 0 or right_table.num_rows == 0:
            return _empty(schema)
        return kernel(left_table, right_table)

    # Fresh column identities: both sides usually come from the same table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return (left.groupBy("lblk", "rblk")
            .cogroup(right.groupBy("lblk", "rblk"))
            .applyInArrow(run, schema))


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema).empty_table()


def _hit_schema(query_type: T.DataType, doc_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_type),
        T.StructField("doc_id", doc_type),
        T.StructField("score", T.DoubleType()),
    ])


# ----------------------------------------------------------------------- exact top-k

def mips_topk(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
              doc_id: str = "doc_id", vec: str = "embedding", exclude_self: bool = False,
              broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS,
              set_bytes: int = SET_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of largest cosine per query.

    Scores are compared at six decimals, ties by doc_id; ranks start at 1. Ids are unique
    on each side. ``exclude_self`` leaves out the document with the query's own id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vec).alias("v"))
    c = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vec).alias("v"))
    schema = _hit_schema(q.schema["query_id"].dataType, c.schema["doc_id"].dataType)
    # At most broadcast_rows + 1 rows ever reach the driver; more means the block path.
    probe = q.limit(broadcast_rows + 1).toArrow()
    if probe.num_rows <= broadcast_rows and probe.nbytes <= BROADCAST_BYTES:
        partial = _topk_by_scan(probe, c, k, schema, exclude_self)
    else:
        partial = _topk_by_blocks(q, c, k, schema, exclude_self, block_rows, set_bytes)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (partial.withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def _topk_by_scan(probe: pa.Table, corpus: DataFrame, k: int, schema: T.StructType,
                  exclude_self: bool) -> DataFrame:
    ids = to_ids(probe["query_id"])
    sent = corpus.sparkSession.sparkContext.broadcast((ids, to_unit(to_matrix(probe["v"]))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = sent.value
        row = np.zeros(0, dtype=np.int64)
        docs, score = None, np.zeros(0)
        floor = np.full(len(query_ids), -np.inf)
        step = max(64, SCAN_SCORES // len(query_ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                d = to_ids(part.column(0))
                cosines = q @ to_unit(to_matrix(part.column(1))).T
                r, j, s = select_top(cosines, query_ids, d, k, floor, exclude_self)
                row = np.concatenate([row, r])
                docs = d[j] if docs is None else np.concatenate([docs, d[j]])
                score = np.concatenate([score, s])
                top = best_k(row, docs, score, k)
                row, docs, score = row[top], docs[top], score[top]
                full = np.bincount(row, minlength=len(query_ids)) >= k
                lowest = np.full(len(query_ids), np.inf)
                np.minimum.at(lowest, row, score)
                floor = np.where(full, lowest, -np.inf)
        if docs is not None and len(row):
            yield _hits(query_ids[row], docs, score, schema).to_batches()[0]

    if len(ids) == 0:
        return corpus.sparkSession.createDataFrame([], schema)
    return corpus.mapInArrow(scan, schema)


def _hits(q: np.ndarray, d: np.ndarray, s: np.ndarray, schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(schema)
    arrays = [pa.array(x).cast(f.type) for x, f in zip((q, d, s), target, strict=True)]
    return pa.Table.from_arrays(arrays, schema=target).combine_chunks()


# Cells: rows are grouped by their nearest pivot (a sampled corpus row). With the largest
# angle between a cell's rows and its pivot, the triangle inequality bounds the cosine of a
# query to every row of the cell, so whole cells are left out without losing a result.
MAX_PIVOTS = 4096
_SLACK = 1e-5  # on cosines, far above rounding at six decimals


@dataclass(frozen=True)
class Cells:
    pivots: np.ndarray        # unit rows
    radius: np.ndarray        # largest angle of a row to its pivot
    first_block: list[int]    # number of the cell's first block
    blocks: list[int]         # blocks of the cell, each of about block_rows rows

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible cosine of each row to each cell."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1.0, 1.0))
        low = np.cos(np.minimum(angle + self.radius, np.pi)) - _SLACK
        high = np.cos(np.maximum(angle - self.radius, 0.0)) + _SLACK
        return low, high


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``angle`` to it; ``df`` has the columns id, v."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(64, SCAN_SCORES // len(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cos = to_unit(to_matrix(part.column(1))) @ sent.value.T
                cell = cos.argmax(axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle)],
                    names=schema.names)

    return df.mapInArrow(place, schema)


def stored_cells(corpus: DataFrame, block_rows: int, seed: int = 42
                 ) -> tuple[Cells, DataFrame] | None:
    """Cells of ``corpus`` (id, v, more), and its rows with ``cell`` and ``angle``, placed once and
    stored. At most MAX_PIVOTS vectors and cell sizes reach the driver. A cell that holds much of
    the table is cut into many blocks."""
    pivots = min(MAX_PIVOTS, block_count(corpus, block_rows))
    picked = (corpus.select("v", hash_key("id", seed).alias("h"), "id")
              .orderBy("h", "id").limit(pivots).select("v").toArrow())
    if picked.num_rows == 0:
        return None
    matrix = to_unit(to_matrix(picked["v"]))
    placed = cut_lineage(_with_cell(corpus, matrix))
    stats = (placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r"))
             .orderBy("cell").collect())
    used = [s.cell for s in stats]  # a repeated pivot has no rows of its own
    blocks = [-(-s.n // block_rows) for s in stats]
    first = [0, *np.cumsum(blocks)[:-1].tolist()]
    number = {c: k for k, c in enumerate(used)}
    placed = placed.withColumn(
        "cell", _lookup([number.get(c, -1) for c in range(len(matrix))]).cast("int"))
    return Cells(matrix[used], np.array([s.r for s in stats]), first, blocks), placed


def build_cells(corpus: DataFrame, block_rows: int, seed: int = 42) -> Cells | None:
    """Cells of ``corpus`` (id, v)."""
    found = stored_cells(corpus, block_rows, seed)
    return found[0] if found else None


def _lookup(values: list[int], cell: str = "cell") -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(cell) + 1)


def _block_in_cell(first: list[int], blocks: list[int], id_col: str) -> Column:
    return (_lookup(first) + F.pmod(F.xxhash64(id_col), _lookup(blocks))).cast("int")


def place_in_blocks(df: DataFrame, cells: Cells, out: str) -> DataFrame:
    """(id, v, cell, angle, out): the block of each corpus row, placed here if it isn't yet."""
    placed = df if "cell" in df.columns else _with_cell(df, cells.pivots)
    return placed.withColumn(out, _block_in_cell(cells.first_block, cells.blocks, "id"))


def _chunk_numbers(placed: DataFrame, cells: Cells, block_rows: int) -> tuple[list, list, int]:
    """First chunk and number of chunks of each cell's queries, and how many queries there are."""
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    chunks = [max(1, -(-counts.get(c, 0) // block_rows)) for c in range(len(cells.blocks))]
    return [0, *np.cumsum(chunks)[:-1].tolist()], chunks, sum(counts.values())


def chunk_queries(df: DataFrame, cells: Cells, block_rows: int) -> DataFrame:
    """(id, v, cell, angle, lblk): query rows in chunks of bounded size, near queries
    together. Rows that aren't placed yet are placed once and stored."""
    placed = df if "cell" in df.columns else cut_lineage(_with_cell(df, cells.pivots))
    first, chunks, _ = _chunk_numbers(placed, cells, block_rows)
    return placed.withColumn("lblk", _block_in_cell(first, chunks, "id"))


def route(queries: DataFrame, cells: Cells, wanted: Callable) -> DataFrame:
    """One row per query and corpus block (``rblk``) that may matter to it.

    ``wanted(low, high, limits)`` says which cells a query needs, from the bounds on its
    cosines and the query's column ``floor``.
    """
    sent = queries.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType([*queries.schema.fields,
                           T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    at_v, at_floor = queries.columns.index("v"), queries.columns.index("floor")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(64, SCAN_SCORES // len(sent.value.blocks))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                low, high = sent.value.bounds(to_unit(to_matrix(part.column(at_v))))
                floor = part.column(at_floor).to_numpy(zero_copy_only=False)
                keep = wanted(low, high, floor[:, None])
                ends = np.concatenate([[0], keep.sum(axis=1).cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.nonzero(keep)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    first, blocks = _lookup(cells.first_block, "_cell"), _lookup(cells.blocks, "_cell")
    return (queries.mapInArrow(choose, schema)
            .withColumn("_cell", F.explode("_cells")).drop("_cells")
            .withColumn("rblk", F.explode(F.sequence(first, first + blocks - 1)))
            .drop("_cell"))


def meet(routed: DataFrame, corpus_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the block join: a corpus block is copied only to the query chunks that
    ask for it."""
    asked = routed.select("lblk", "rblk").distinct()
    return routed, corpus_blocks.join(asked, "rblk")


# Sets: what one task keeps of each side. Blocks of the corpus, cells in a row, make a set of as
# many bytes as a task may hold, and queries come in GROUPS chunks until these grow too large. So
# a corpus row is copied to a number of chunks that does not depend on the table, and a query once
# per set, until the table is many times what a task holds. Bounds on cells are used twice: a
# query is sent only to sets, and inside a set meets only slices, that may matter to it.
GROUPS, GROUP_ROWS, LEAST_ROWS = 32, 32_768, 64
SLICE_ROWS = 8192


@dataclass(frozen=True)
class Sets:
    cells: Cells
    count: int

    def of_block(self) -> np.ndarray:
        blocks = np.arange(sum(self.cells.blocks))
        return blocks * self.count // len(blocks)

    def of_cell(self) -> np.ndarray:
        """Which cells (rows) have blocks in which sets (columns)."""
        member = np.zeros((len(self.cells.blocks), self.count), np.float32)
        member[np.repeat(np.arange(len(member)), self.cells.blocks), self.of_block()] = 1
        return member


def _sets(cells: Cells, block_rows: int, set_bytes: int) -> Sets:
    blocks, dims = sum(cells.blocks), max(1, cells.pivots.shape[1])
    rows = max(block_rows, set_bytes // (8 * dims))
    return Sets(cells, min(blocks, -(-blocks * block_rows // rows)))


def _in_groups(placed: DataFrame, cells: Cells, block_rows: int) -> tuple[DataFrame, int]:
    """Placed queries (id, v, cell) with ``lblk``, their chunk, near queries together; and the
    number of chunks."""
    first, chunks, rows = _chunk_numbers(placed, cells, block_rows)
    groups = max(min(GROUPS, -(-rows // LEAST_ROWS)), -(-rows // GROUP_ROWS), 1)
    at = _block_in_cell(first, chunks, "id") * 1024 + F.pmod(
        F.xxhash64("id", F.lit("group")), F.lit(1024))
    return placed.withColumn(
        "lblk", F.floor(at * F.lit(groups) / F.lit(1024 * sum(chunks))).cast("int")), groups


def _route_to_sets(queries: DataFrame, sets: Sets, wanted: Callable) -> DataFrame:
    """One row per query and set (``rblk``) that may matter to it, by ``wanted`` as in route."""
    sent = queries.sparkSession.sparkContext.broadcast(sets)
    schema = T.StructType([*queries.schema.fields, T.StructField("rblk", T.IntegerType())])
    at_v, at_floor = queries.columns.index("v"), queries.columns.index("floor")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = sent.value.of_cell()
        step = max(64, SCAN_SCORES // len(member))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                low, high = sent.value.cells.bounds(to_unit(to_matrix(part.column(at_v))))
                floor = part.column(at_floor).to_numpy(zero_copy_only=False)
                keep = wanted(low, high, floor[:, None])
                row, number = np.nonzero(keep.astype(np.float32) @ member)
                copied = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*copied.columns, pa.array(number.astype(np.int32))], names=schema.names)

    return queries.mapInArrow(choose, schema)


def _in_sets(placed: DataFrame, sets: Sets) -> DataFrame:
    """(id, v, block, rblk): the set of each placed corpus row."""
    return place_in_blocks(placed, sets.cells, "block").select(
        "id", "v", "block", F.floor(F.col("block") * F.lit(sets.count)
                                    / F.lit(sum(sets.cells.blocks))).cast("int").alias("rblk"))


def _meet_in_units(left: DataFrame, right: DataFrame, units: int, kernel: Callable,
                   schema: T.StructType) -> DataFrame:
    """Each chunk meets each set that it asks for. Units are dealt by chunk and set: a shuffle by
    the set alone, which the joins would be content with, puts all chunks into one task."""
    parts = min(max(64, 2 * units), 4096)
    left, right = (x.repartition(parts, "lblk", "rblk") for x in meet(left, right))
    return join_blocks(left, right, kernel, schema)


def _slices(lt: pa.Table, rt: pa.Table, cells: Cells, wanted: Callable, floor: np.ndarray
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of lt, rows of rt, their cosines), a slice of few cells and some thousand cosines
    wide at a time; only rows of lt that the slice may matter to, by ``floor`` as it is then."""
    q = to_unit(to_matrix(lt["v"]))
    block = rt["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    cell_of = np.repeat(np.arange(len(cells.blocks)), cells.blocks)
    for at in range(0, len(order), SLICE_ROWS):
        right = order[at:at + SLICE_ROWS]
        d = to_unit(to_matrix(rt["v"].take(pa.array(right)))).T
        near = np.unique(cell_of[block[right]])
        own = Cells(cells.pivots[near], cells.radius[near], [], [])
        step = max(64, SCAN_SCORES // len(right))
        for s in range(0, len(q), step):
            low, high = own.bounds(q[s:s + step])
            rows = s + np.nonzero(wanted(low, high, floor[s:s + step, None]).any(axis=1))[0]
            if len(rows):
                yield rows, right, q[rows] @ d


def _topk_of_set(lt: pa.Table, rt: pa.Table, cells: Cells, k: int, exclude_self: bool,
                 schema: T.StructType) -> pa.Table:
    qi, di = to_ids(lt["id"]), to_ids(rt["id"])
    floor = np.array(lt["floor"].to_numpy())
    row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    found, held = [], 0

    def best() -> None:
        nonlocal row, col, score, found, held
        row, col, score = (np.concatenate(x) for x in zip((row, col, score), *found, strict=True))
        top = best_k(row, di[col], score, k)
        row, col, score = row[top], col[top], score[top]
        lowest = np.full(len(qi), np.inf)
        np.minimum.at(lowest, row, score)
        full = np.bincount(row, minlength=len(qi)) >= k
        floor[full] = np.maximum(floor[full], lowest[full])
        found, held = [], 0

    for rows, right, cosines in _slices(lt, rt, cells, lambda low, high, f: high >= f, floor):
        r, c, s = select_top(cosines, qi[rows], di[right], k, floor[rows], exclude_self)
        found.append((rows[r], right[c], s))
        held += len(r)
        if held > max(1 << 18, len(qi) * k):
            best()
    if held:
        best()
    return _hits(qi[row], di[col], score, schema)


def _topk_by_blocks(q: DataFrame, c: DataFrame, k: int, schema: T.StructType,
                    exclude_self: bool, block_rows: int, set_bytes: int = SET_BYTES) -> DataFrame:
    """Exact top-k in two rounds. Each query first meets one block of its nearest cell; its
    k-th best score there is a lower bound, and only cells that can beat it come next."""
    queries = q.withColumnRenamed("query_id", "id")
    docs = c.withColumnRenamed("doc_id", "id")
    found = stored_cells(docs, block_rows)
    if found is None:
        return q.sparkSession.createDataFrame([], schema)
    cells, placed = found
    right = place_in_blocks(placed, cells, "rblk").select("id", "v", "rblk")
    chunked = chunk_queries(queries, cells, block_rows)
    seed_block = (_lookup(cells.first_block) + F.pmod("lblk", _lookup(cells.blocks))).cast("int")
    lowest = F.lit(float("-inf"))

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        qi, di = to_ids(lt["id"]), to_ids(rt["id"])
        cosines = to_unit(to_matrix(lt["v"])) @ to_unit(to_matrix(rt["v"])).T
        r, j, s = select_top(cosines, qi, di, k, lt["floor"].to_numpy(), exclude_self)
        return _hits(qi[r], di[j], s, schema)

    seeded = chunked.withColumn("rblk", seed_block).withColumn("floor", lowest)
    near = join_blocks(*meet(seeded, right), kernel, schema)
    if sum(cells.blocks) == 1:
        return near
    floors = cut_lineage(near.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_floor")))
    grouped, groups = _in_groups(chunked.drop("lblk"), cells, block_rows)
    known = (grouped.join(floors, "id", "left")
             .select("id", "v", "lblk", F.coalesce("_floor", lowest).alias("floor")))
    sets = _sets(cells, block_rows, set_bytes)
    far = _route_to_sets(known, sets, lambda low, high, floor: high >= floor)
    sent = q.sparkSession.sparkContext.broadcast(cells)
    return _meet_in_units(
        far, _in_sets(placed, sets), groups * sets.count, lambda lt, rt: _topk_of_set(
            lt, rt, sent.value, k, exclude_self, schema), schema)


# ------------------------------------------------------- all pairs, pre-aggregated only

def similarity_range_counts(df: DataFrame, lo: float, hi: float, *, id_col: str = "id",
                            vec: str = "embedding", block_rows: int = BLOCK_ROWS,
                            set_bytes: int = SET_BYTES) -> DataFrame:
    """Range join in aggregated form: per row, how many other rows have
    lo <= cosine <= hi, and the mean, smallest and largest such cosine."""
    base = df.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    schema = T.StructType([base.schema["id"], *[
        T.StructField(n, t) for n, t in (
            ("n", T.LongType()), ("total", T.DoubleType()),
            ("low", T.DoubleType()), ("high", T.DoubleType()))]])
    found = stored_cells(base, block_rows)
    if found is None:
        return df.sparkSession.createDataFrame([], T.StructType([
            T.StructField(id_col, base.schema["id"].dataType),
            T.StructField("n_in_range", T.LongType()),
            *[T.StructField(n, T.DoubleType()) for n in ("mean_sim", "min_sim", "max_sim")]]))
    cells, placed = found
    # Cells whose cosines all lie outside the range are never met.
    def wanted(low: np.ndarray, high: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return (high >= floor) & (low <= hi)

    sets = _sets(cells, block_rows, set_bytes)
    grouped, groups = _in_groups(placed, cells, block_rows)
    left = _route_to_sets(grouped.select("id", "v", "lblk", F.lit(lo).alias("floor")), sets, wanted)
    sent = df.sparkSession.sparkContext.broadcast(cells)

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        li, ri = to_ids(lt["id"]), to_ids(rt["id"])
        n, total = np.zeros(len(li), np.int64), np.zeros(len(li))
        low, high = np.full(len(li), np.inf), np.full(len(li), -np.inf)
        for rows, right, cosines in _slices(lt, rt, sent.value, wanted, lt["floor"].to_numpy()):
            s = np.round(cosines, DECIMALS)
            inside = (s >= lo) & (s <= hi) & (li[rows][:, None] != ri[right][None, :])
            n[rows] += inside.sum(axis=1)
            total[rows] += np.where(inside, s, 0.0).sum(axis=1)
            low[rows] = np.minimum(low[rows], np.where(inside, s, np.inf).min(axis=1))
            high[rows] = np.maximum(high[rows], np.where(inside, s, -np.inf).max(axis=1))
        return pa.table({"id": lt["id"], "n": n, "total": total, "low": low, "high": high})

    counted = _meet_in_units(left, _in_sets(placed, sets), groups * sets.count, kernel, schema)
    nothing = base.select("id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"),
                          F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"))
    some = F.sum("n") > 0
    return (counted.unionByName(nothing)  # rows without any such partner
            .groupBy(F.col("id").alias(id_col))
            .agg(F.sum("n").alias("n_in_range"),
                 F.when(some, F.sum("total") / F.sum("n")).alias("mean_sim"),
                 F.when(some, F.min("low")).alias("min_sim"),
                 F.when(some, F.max("high")).alias("max_sim")))


def self_similarity_moments(df: DataFrame, *, vec: str = "embedding") -> DataFrame:
    """Count, mean and population standard deviation of the cosine over all off-diagonal
    pairs, exactly and in linear time.

    With unit vectors u: the sum of all u_i.u_j is |sum u|^2, and the sum of their squares
    is the squared Frobenius norm of sum(u u^T). So a task hands on one packed row with
    sum(u u^T), sum(u) and three numbers, these rows are added up in two steps, and no pair
    is ever formed.
    """
    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = total = None
        n, diag, diag2 = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            u = to_unit(to_matrix(batch.column(0)))
            gram = u.T @ u if gram is None else gram + u.T @ u
            total = u.sum(axis=0) if total is None else total + u.sum(axis=0)
            square = (u * u).sum(axis=1)
            n, diag, diag2 = n + len(u), diag + square.sum(), diag2 + (square ** 2).sum()
        if gram is not None:
            packed = np.concatenate([[float(n), diag, diag2], total, gram.ravel()])
            yield pa.RecordBatch.from_pydict({"packed": [packed]})

    def added(parts: DataFrame, by: Column) -> DataFrame:
        return (parts.groupBy(by.alias("slot"))
                .agg(Summarizer.sum(array_to_vector("packed")).alias("s"))
                .select(vector_to_array("s").alias("packed")))

    parts = df.select(vec).mapInArrow(accumulate, "packed array<double>")
    sums = added(added(parts, F.spark_partition_id() % 64), F.lit(0))
    x = F.col("packed")
    dims = F.floor((F.sqrt(4.0 * (F.size(x) - 3) + 1) - 1) / 2).cast("int")

    def squares(first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(x, first, count), F.lit(0.0), lambda acc, y: acc + y * y)

    n, diag, diag2 = (F.element_at(x, i) for i in (1, 2, 3))
    pairs = (n * (n - 1)).cast("long")
    mean = F.try_divide(squares(F.lit(4), dims) - diag, pairs)
    second = F.try_divide(squares(4 + dims, dims * dims) - diag2, pairs)
    one = sums.select(pairs.alias("n_pairs"), mean.alias("m"), second.alias("m2"))
    # An aggregate over at most one row, so that an empty table gives a row as well.
    return one.agg(
        F.coalesce(F.max("n_pairs"), F.lit(0)).alias("n_pairs"), F.max("m").alias("mean_sim"),
        F.max(F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0))))
        .alias("std_sim"))


def self_similarity_histogram(df: DataFrame, *, id_col: str = "id", vec: str = "embedding",
                              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sim, n): how many off-diagonal pairs (each direction counted) have a cosine that is
    ``sim`` at six decimals, whatever the number of pairs."""
    from tripletspark.operators.tiles import pair_histogram
    return (pair_histogram(df, id_col, vec, block_rows=block_rows)
            .select("sim", (2 * F.col("n")).alias("n")))


def self_similarity(df: DataFrame, *, id_col: str = "id", vec: str = "embedding",
                    above: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Statistics of all off-diagonal cosines, taken at six decimals: count, mean, median,
    population standard deviation, min, max, quartiles and the percentage above a limit."""
    from tripletspark.operators.metrics import weighted_stats
    hist = self_similarity_histogram(df, id_col=id_col, vec=vec, block_rows=block_rows)
    return weighted_stats(hist, "sim", "n", above=above)


STRATEGIES = ("hardest", "semi-hard", "random")


def ranked_negatives(df: DataFrame, n: int, strategy: str = "hardest", top_k: int = 50, *,
                     id_col: str = "id", vec: str = "embedding", seed: int = 42,
                     **options) -> DataFrame:
    """(id, rank, neg_id, score): n of the top_k most similar other rows, as ``pick_ranked``
    takes them."""
    if not 1 <= n <= top_k:
        raise ValueError("need 1 <= n <= top_k")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    hits = mips_topk(df, df, top_k, query_id=id_col, doc_id=id_col, vec=vec,
                     exclude_self=True, **options)
    return pick_ranked(hits, n, strategy, id_col=id_col, seed=seed)


def pick_ranked(hits: DataFrame, n: int, strategy: str, *, id_col: str = "id",
                seed: int = 42) -> DataFrame:
    """(id, rank, neg_id, score) from ranked hits, which several strategies can share.

    ``hardest`` takes ranks 1..n, ``semi-hard`` the n ranks around the middle of the list,
    ``random`` the first n in hash order.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    per_query = Window.partitionBy("query_id")
    if strategy == "hardest":
        kept = hits.filter(F.col("rank") <= n)
    elif strategy == "semi-hard":
        first = F.floor((F.count(F.lit(1)).over(per_query) - n) / 2)
        kept = (hits.withColumn("_first", F.greatest(first, F.lit(0)))
                .filter((F.col("rank") > F.col("_first")) & (F.col("rank") <= F.col("_first") + n))
                .drop("_first"))
    else:
        key = hash_key(F.concat_ws("/", "query_id", "doc_id"), seed)
        kept = (hits.withColumn("_o", F.row_number().over(
                    per_query.orderBy(key, "doc_id")))
                .filter(F.col("_o") <= n).drop("_o"))
    return kept.select(F.col("query_id").alias(id_col), "rank",
                       F.col("doc_id").alias("neg_id"), "score")
