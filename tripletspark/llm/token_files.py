"""Token files: ids of all documents in one array, document borders in Elias-Fano form.

A file holds the ids of consecutive documents (2 bytes an id where the vocabulary allows), the
end of every document as an Elias-Fano sequence, and the doc_ids as another one. Such a sequence
of m numbers up to u takes about m * (2 + log2(u / m)) bits: the low bits lie side by side, the
high bits are a bit vector in which number i sets bit (high + i). The place of every 512th set bit
is stored in 4 bytes, so number i is found by looking at a few words of the vector; there is no
table of 64-bit offsets.

Writing: quantiles of doc_id cut the documents into parts, a scan encodes the texts, a shuffle by
part moves the ids (never the texts), and every task writes the files of its parts one after the
other under a name of its own attempt. The manifest is
written by Spark after that; only files that it lists count, so a task that is repeated or lost
leaves nothing that is read. Reading starts from the manifest, whose running sums give the ids
before each file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripletspark.llm.tables import texts
from tripletspark.session import scratch_path

TOKENIZER, END_ID = "word_bpe_49k", 2
#: Most ids of a file (one text may have more), documents of a part, and most parts.
FILE_IDS = 1 << 23
PART_DOCS, MAX_PARTS = 8192, 20_000
SAMPLE = 512
MAGIC = b"TOKENS01"
#: Magic, bytes an id, documents, ids, documents without a doc_id, smallest doc_id; then of both
#: sequences: count, low bits, bytes of high bits, low bits and samples; crc32 of all that follows.
HEADER = struct.Struct("<8sQQQQq" + "QQQQQ" * 2 + "Q")
MANIFEST = "part long, number long, path string, n_docs long, n_ids long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ------------------------------------------------------------------ Elias-Fano sequences

class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray,
                 samples: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.high, self.low, self.samples = high, low, samples

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            none = np.zeros(0, np.uint8)
            return EliasFano(0, 0, none, none, np.zeros(0, np.uint32))
        k = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        low = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :k]
        return EliasFano(n, k, np.packbits(bits, bitorder="little"),
                         np.packbits(low.ravel(), bitorder="little"),
                         places[::SAMPLE].astype(np.uint32))

    def all(self) -> np.ndarray:
        """The whole sequence."""
        places = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0][:self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits)
            wide = np.zeros((self.n, 64), np.uint8)
            wide[:, :self.low_bits] = bits.reshape(self.n, self.low_bits)
            out |= np.packbits(wide, axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def select(self, i: int) -> int:
        """The place of set bit ``i`` of the high bits: from the sample before it, by counting."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        left += int(self.high[byte] & ((1 << skip) - 1)).bit_count()
        while True:
            part = self.high[byte:byte + 64]
            ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
            if ones[-1] > left:
                k = int(np.searchsorted(ones, left, side="right"))
                left -= int(ones[k - 1]) if k else 0
                bits = np.nonzero(np.unpackbits(part[k:k + 1], bitorder="little"))[0]
                return (byte + k) * 8 + int(bits[left])
            left, byte = left - int(ones[-1]), byte + 64

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, k = self.select(i) - i, self.low_bits
        first = i * k
        raw = int.from_bytes(self.low[first // 8:(first + k + 7) // 8].tobytes(), "little")
        return (value << k) | ((raw >> first % 8) & ((1 << k) - 1))

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.high, self.low, self.samples)]


# --------------------------------------------------------------------------------- files

def file_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file of documents in order, those without a doc_id first; ``ids``: little-endian
    numbers of ``width`` bytes."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    body = b"".join(ids)
    pad = b"\0" * (-len(body) % 8)
    head, sections = [], []
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.uint64)
    for seq in (EliasFano.of(ends), EliasFano.of(known.view(np.uint64) - np.uint64(base % (1 << 64)))):
        parts = seq.parts()
        head += [seq.n, seq.low_bits, *map(len, parts)]
        sections += parts
    rest = b"".join([body, pad, *sections])
    return HEADER.pack(MAGIC, width, len(ids), len(body) // width, len(ids) - len(known), base,
                       *head, zlib.crc32(rest)) + rest


class TokenFile:
    """A file's documents, from its bytes or a memory map: single ones by select, or all."""

    def __init__(self, data):
        data = memoryview(data)
        (magic, width, self.n_docs, self.n_ids, self.n_null, self.base, *head,
         self.crc) = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.data, at = data, HEADER.size
        self.tokens = np.frombuffer(data, f"<u{width}", self.n_ids, at)
        at += self.n_ids * width
        at += -(at - HEADER.size) % 8
        found = []
        for k in (0, 5):
            n, low_bits, *sizes = head[k:k + 5]
            arrays = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                arrays.append(np.frombuffer(data[at:at + size], kind))
                at += size
            found.append(EliasFano(n, low_bits, *arrays))
        self.ends, self.known = found
        self.size = at

    def check(self) -> None:
        if zlib.crc32(self.data[HEADER.size:self.size]) != self.crc:
            raise ValueError("damaged token file")

    def doc_id(self, i: int) -> int | None:
        if i < self.n_null:
            return None
        value = (self.known[i - self.n_null] + self.base) % (1 << 64)
        return value - (1 << 64) if value >> 63 else value

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        return self.tokens[self.ends[i - 1] if i else 0:self.ends[i]]

    def find(self, doc_id: int) -> int:
        """The number of the first document of this doc_id, by bisection; -1: not here."""
        low, high = self.n_null, self.n_docs
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.doc_id(mid) < doc_id else (low, mid)
        return low if low < self.n_docs and self.doc_id(low) == doc_id else -1

    def doc_ids(self) -> pa.Array:
        known = (self.known.all() + np.uint64(self.base % (1 << 64))).view(np.int64)
        return pa.concat_arrays([pa.nulls(self.n_null, pa.int64()), pa.array(known)])


def _place(path: str):
    """The file system and path of a URI or local path, reachable from any task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would give it."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "/", out)


# ------------------------------------------------------------------------------ encoding

class TextIds:
    """The ids of a text as bytes, as the tokenizers library gives them.

    Plain texts (ASCII and Latin letters) are cut by the tokenizer's own pattern and merged by
    tiktoken, which is given the same vocabulary: the mark of a word's end is a byte that no
    piece holds, and merging it with the last letter comes before all other merges, as the
    single letters at word ends have the lowest ids. All other texts, and those with very long
    pieces or what could be a special token, go through tokenizers.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        path = public_tokenizers.path(f"{name}.json")
        self.full = Tokenizer.from_file(path)
        self.width = 2 if self.full.get_vocab_size() <= 1 << 16 else 4
        self.plain = None
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        if parts["model"].get("end_of_word_suffix") == _SUFFIX:
            self.plain = tiktoken.Encoding(
                "words", pat_str="[^\x00]+\x00", mergeable_ranks=_ranks(parts["model"]["vocab"]),
                special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        found = None
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            pieces = _PIECE.findall(text.lower())
            if not pieces:
                return b""
            if max(map(len, pieces)) <= _LONG:
                found = self.plain("\0".join(pieces) + "\0")
        if found is None:
            found = self.full.encode(text, add_special_tokens=False).ids
        return np.array(found, f"<u{self.width}").tobytes()


_SUFFIX = "</w>"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: The tokenizer's pattern for its pieces, for lower-cased plain texts.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|"
                    "[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
_LONG = 400


def _ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """Byte strings and their ids; a word's end is a zero byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in t.removesuffix(_SUFFIX))
            + (b"\0" if t.endswith(_SUFFIX) else b""): i for t, i in vocab.items()}


@functools.cache
def text_ids(name: str) -> TextIds:
    """The tokenizer of this Python worker, which serves one task after the other."""
    return TextIds(name)


def _part_of(doc_ids: pa.Array, rows: np.ndarray, bounds: np.ndarray, without: int) -> np.ndarray:
    """The part of each document: ``without`` parts for rows without a doc_id, then one up to
    each bound. A doc_id that fills several parts is dealt to these by its row."""
    known = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    first = np.searchsorted(bounds, known, side="left")
    span = np.maximum(1, np.searchsorted(bounds, known, side="right") - first)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, rows % max(1, without), without + first + rows % span)


def _encode(name: str, end_id: int, bounds: np.ndarray, without: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_ids(name)
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                doc_ids, text, row = batch.slice(at, 1000).columns
                ids = [coder.ids(t) + end for t in text.to_pylist()]
                part = _part_of(doc_ids, row.to_numpy(), bounds, without)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), doc_ids,
                     pa.array([hashlib.md5(x).digest() for x in ids]), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "tie", "ids"])
    return run


def _write_files(name: str, folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, attempt = text_ids(name).width, TaskContext.get().taskAttemptId()
        docs: list[int | None] = []
        ids: list[bytes] = []
        held, number, current = 0, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            path = f"{folder}/{current:06d}-{number:04d}-{attempt}.tokens"
            data = file_bytes(docs, ids, width)
            fs, at = _place(path)
            with fs.open_output_stream(at) as out:
                out.write(data)
            row = [current, number, path, len(docs), held, len(data)]
            docs.clear()
            ids.clear()
            held, number = 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in row],
                names=["part", "number", "path", "n_docs", "n_ids", "n_bytes"])
        for batch in batches:
            for part, doc_id, x in zip(*(batch.column(c).to_pylist()
                                         for c in ("part", "doc_id", "ids")), strict=True):
                n = len(x) // width
                if docs and (part != current or held + n > file_ids):
                    yield flush()
                if part != current:
                    current, number = part, 0
                docs.append(doc_id)
                ids.append(x)
                held += n
        if docs:
            yield flush()
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER,
                      end_id: int = END_ID, file_ids: int = FILE_IDS,
                      part_docs: int = PART_DOCS) -> DataFrame:
    """Write the ids of all documents, each with ``end_id`` behind, in ascending doc_id order to
    ``folder``/data, and return the manifest (stored in ``folder``/manifest).

    Null and empty texts hold the end id alone. Null doc_ids come first; rows of one doc_id lie
    side by side, those of one part by the md5 of their ids; repeated rows stand as often as they
    occur. Rows without a doc_id or of one doc_id may be a third of all: they fill as many parts
    as their number asks for. A text longer than ``file_ids`` has a file of its own. Other columns
    stay out. No documents: no files and an empty manifest.
    """
    from pyarrow import fs as arrow_fs
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                              F.monotonically_increasing_id().alias("row"))
    seen = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    parts = min(MAX_PARTS, seen.known // part_docs + 1)
    without = min(MAX_PARTS, -(-(seen.n - seen.known) // part_docs))
    bounds = rows.agg(F.percentile_approx(
        "doc_id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).first()[0]
    bounds = np.array(bounds if parts > 1 else [], np.int64)
    fs, at = _place(f"{folder}/data")
    if not isinstance(fs, arrow_fs.S3FileSystem):
        fs.create_dir(at)
    (rows.mapInArrow(_encode(tokenizer, end_id, bounds, without),
                     "part long, doc_id long, tie binary, ids binary")
     .repartitionById(parts + without, F.col("part").cast("int"))
     .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
     .select("part", "doc_id", "ids")
     .mapInArrow(_write_files(tokenizer, f"{folder}/data", file_ids), MANIFEST)
     .write.parquet(f"{folder}/manifest"))
    return spark.read.parquet(f"{folder}/manifest")


def _with_starts(manifest: DataFrame) -> DataFrame:
    """The ids before each file: sums over runs of 1024 partitions, then inside the runs."""
    runs = manifest.withColumn("run", F.col("part").bitwiseAND(~1023))
    first = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (runs.groupBy("run").agg(F.sum("n_ids").alias("n"))
              .select("run", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("run_start")))
    inside = (Window.partitionBy("run").orderBy("part", "number")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (runs.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(F.broadcast(starts), "run")
            .select("path", (F.col("run_start") + F.col("inside")).alias("first")))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the manifest. A
    file that is damaged ends the job. An empty manifest: no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(),
                                   batch.column("first").to_pylist(), strict=True):
                fs, at = _place(path)
                with fs.open_input_file(at) as stored:
                    file = TokenFile(stored.read())
                file.check()
                ends = file.ends.all().astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                doc_ids = file.doc_ids()
                for k in range(0, file.n_docs, 10_000):
                    borders = list(zip(starts[k:k + 10_000].tolist(), ends[k:k + 10_000].tolist(),
                                       strict=True))
                    crc = [zlib.crc32(file.tokens[s:e].astype("<u4")) for s, e in borders]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(k, 10_000), pa.array([first + s for s, _ in borders]),
                         pa.array([e - s for s, e in borders]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
    manifest = spark.read.parquet(f"{qualified(spark, folder)}/manifest")
    files = max(1, manifest.count())
    return (_with_starts(manifest).repartition(min(files, 100_000), "path")
            .mapInArrow(run, READ))


def token_files(docs: DataFrame, **options) -> DataFrame:
    """The documents written to the shared folder and read back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, **options)
    return read_token_files(docs.sparkSession, folder)
