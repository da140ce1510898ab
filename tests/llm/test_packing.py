from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import plain
from tripletspark.llm import packing
from tripletspark.llm.packing import PieceCache, best_fit, cut, pack

ODD = ["", None, " ", "  ", "a  b", " a\n b \n c", "x<|endoftext|> y  <|endoftext|>", "\u3000 a \xa0 b",
       "a\u2003 b", "日本 語 \x85 z\x1c q", "it's  he'll  \n\n  x", "don’t \t\t a\r\n b", "ª º ² ½ á b",
       "word " * 9000, "😀" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizer_s(spark, sf, tokenizer):
    cache = PieceCache("byte_bpe_50k", limit=500)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in [*texts, *[t or "" for t in ODD]]:
        want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert cache.ids(t) == want


def test_pieces_and_bins(spark, sf, tokenizer):
    docs = plain.documents(spark, sf, [(9000 + i, t, None) for i, t in enumerate(ODD)]
                           + [(9001, "twice", "a"), (9001, "twice", "a"), (None, "nameless", "a")])
    docs = docs.repartition(20)
    rows = pack(docs, fan_in=3).collect()
    want, total = [], 0
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        for k, (s, n) in enumerate(cut(len(ids), 1024)):
            crc = zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())
            want.append((str(r.doc_id), k, s, n, crc))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == \
        sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) * 1.06 + 1
    assert pack(docs.limit(0)).count() == 0


def test_cut_and_best_fit():
    assert cut(3, 4) == [(0, 3)] and cut(4, 4) == [(0, 4)] and cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 3000)
    bins, places, fill = best_fit(lengths, 100)
    assert fill.max() <= 100 and fill.sum() == lengths.sum()
    assert len(fill) <= lengths.sum() / 100 * 1.05
    assert [*best_fit(np.zeros(0, np.int64), 10)[2]] == []


def test_many_bins_that_cannot_pair(spark, monkeypatch):
    """A third of all documents have some 700 tokens, so their bins all go up: no task merges more
    than its bound, no piece is lost, and the number of sequences stays near the least."""
    rows = [(i, "word " * (700 if i % 3 == 0 else 5 + i % 40)) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    seen, whole = [], packing._dealt

    def dealt(pooled, most):
        out = whole(pooled, most)
        seen.append(out.groupBy("g", "part").count().agg({"count": "max"}).first()[0])
        return out
    monkeypatch.setattr(packing, "_dealt", dealt)
    least = None
    for most in (200_000, 100):
        seen.clear()
        got = pack(df, fan_in=3, merge_most=most).collect()
        assert max(x or 0 for x in seen) <= (1.4 * most if most == 100 else 600)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024
        assert sorted(r.doc_id for r in got) == list(range(1800))
        least = least or len(bins)
        assert len(bins) <= least * 1.02
