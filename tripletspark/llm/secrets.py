"""Secret scan: fixed patterns, and strings that zstandard can't explain from what surrounds them.

A candidate's novelty is its marginal compressed size: the bytes by which a frame that is primed
with an identifier dictionary grows when the candidate is put behind its surrounding text. Names,
words and repeats cost little; random strings cost nearly what they hold. What they hold depends on
their alphabet and length (a hexadecimal digit is four bits, and short strings carry a frame's
cost), so a candidate is measured against random strings of its own alphabet and length behind the
same text. Candidates whose context speaks of credentials and that cost nearly as much are
reported.

The texts are scanned in Arrow batches where they lie; nothing is shuffled. The dictionary's
names are counted over all documents first, narrow and combined before the shuffle, and its
size is bounded by a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import texts

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
#: At least 24 digits from the left are what is left of all runs when shorter ones are dropped.
_HEX = re.compile("[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Candidates of letters alone, or without any, are that long at least: long words and numbers.
SINGLE = 24
_LETTER = re.compile("[A-Za-z]")
#: Random strings that a candidate is measured against.
DRAWS = 4
#: Symbols that stand together in an alphabet; all others only for themselves.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
#: Words that make a context sensitive.
SENSITIVE = re.compile(
    r"passw|secret|token|api.?key|auth|bearer|credential|private|access.?key|signature|"
    r"connection.?string|client.?id|session|cookie|login", re.I | re.ASCII)
#: What code around secrets says anyway, and the words that names are made of; the dictionary
#: begins with them.
COMMON = ("this is my the and for with not from into have will your our new old long short name "
          "names identifier value number index list file path test user users id type data set get "
          "key keys public module project package version example document documentation about "
          "service server client request response message error manager handler factory builder "
          "password passwd secret token api_key apikey access_key private_key client_secret "
          "authorization bearer credentials username host port database connection string config "
          "export const public private static final return import class def self function var let "
          "null true false none begin rsa end certificate https://www. http:// .com .org com. org. "
          ".example.com localhost 127.0.0.1 sha256 base64 utf-8 content-type application/json "
          "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 aaaaaaaa "
          "xxxxxxxx ........ -------- ======== ________ _the_ _is_ _of_ _and_ _to_ _name_ _id_ _key_")


def identifier_names(docs: DataFrame, most: int = 2000) -> list[str]:
    """The names that stand before an assignment, call or colon in most documents, the most
    frequent last (nearest to the data in a dictionary). ``most`` bounds what is collected; a
    name has at most 40 characters."""
    pattern = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{2,39}+(?=\x20?[=:(])"
    names = (texts(docs).select(F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("name"))
        .groupBy("name").count().orderBy(F.desc("count"), "name").limit(most))
    return [r["name"] for r in names.collect()][::-1]


class Novelty:
    """Marginal compressed bytes against a dictionary and the surrounding text."""

    def __init__(self, names: list[str], level: int = 19):
        primed = zstandard.ZstdCompressionDict((" ".join(names) + " " + COMMON).encode(),
                                               dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False).compress

    def __call__(self, around: str, candidate: str) -> float:
        """Marginal bytes of the candidate, as a share of what random strings cost there."""
        base = around.encode()
        alone = len(self.pack(base))
        own = len(self.pack(base + candidate.encode())) - alone
        alphabet = _alphabet(candidate)
        random = [len(self.pack(base + _random(alphabet, len(candidate), k))) - alone
                  for k in range(DRAWS)]
        return DRAWS * own / max(1, sum(random))


def _alphabet(candidate: str) -> str:
    """The symbols that a random string of this kind would draw from."""
    found = set(candidate)
    known = "".join(c for c in _CLASSES if found & set(c))
    return known + "".join(sorted(found - set("".join(_CLASSES))))


@functools.lru_cache(512)
def _random(alphabet: str, length: int, number: int) -> bytes:
    """The same string each time for the same arguments."""
    seed = zlib.crc32(f"{alphabet}:{length}:{number}".encode())
    letters = np.frombuffer(alphabet.encode(), np.uint8)
    return letters[np.random.default_rng(seed).integers(0, len(letters), length)].tobytes()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost without overlap in each kind."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, floor: float,
                reach: int) -> list[tuple[int, int, int]]:
    """Strings in a sensitive context that don't compress, and lie in no base span."""
    out, taken, k = [], sorted(taken), 0
    ends = 0  # the furthest end of the base spans that begin before the candidate ends
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][0] < e:
            ends, k = max(ends, taken[k][2]), k + 1
        if ends > s or (e - s < SINGLE and (m[0].isalpha() or not _LETTER.search(m[0]))):
            continue
        before, after = text[max(0, s - reach):s], text[e:e + reach]
        if (SENSITIVE.search(before[-60:]) or SENSITIVE.search(after[:30])) and \
                novelty(after + before, m[0]) >= floor:
            out.append((s, 3, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, floor: float = 0.85, reach: int = 256,
                 names: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and
    spans (``kind:start:end`` by start, then kind; code points, end exclusive).

    ``floor``: the share of a random string's cost from which a candidate is reported. Null and
    empty texts: no spans. Long texts are scanned whole, candidates of any length measured whole.
    Repeated rows give repeated results, other columns (clashing names too) stay out, an empty
    table gives no rows. ``names`` are counted from ``docs`` if not given.
    """
    names = identifier_names(docs) if names is None else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = sorted(base_spans(text))
                new = novel_spans(text, base, novelty, floor, reach)
                counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                rows.append((*counts, len(new), hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(sorted(base + new))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]],
                 *[pa.array(c, pa.string()) for c in cols[4:]]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256",
                       "spans"])
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, "
                                "n_novel long, base_sha256 string, spans string")
