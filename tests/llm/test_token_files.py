"""Token files: the sequences, the files, and whole tables against the tokenizer."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tripletspark.llm import token_files as tf


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60) | st.lists(st.integers(0, 40), max_size=3000))
@settings(max_examples=120, deadline=None)
def test_sequences(values):
    values = sorted(values)
    seq = tf.EliasFano.of(np.array(values, np.uint64))
    assert seq.all().tolist() == values
    assert [seq[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        seq[len(values)]


def test_space_is_near_the_bound():
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 2000, 100_000)).astype(np.uint64)
    bits = 8 * sum(map(len, tf.EliasFano.of(ends).parts()))
    assert bits <= len(ends) * (2 + np.log2(float(ends[-1]) / len(ends))) * 1.05


def test_a_file_and_its_documents(tmp_path):
    ids = [np.array(x, "<u2").tobytes() for x in ([2], [7, 8, 2], [], [49407, 2], [1, 2])]
    doc_ids = [None, -2**63, -5, -5, 2**63 - 1]
    path = tmp_path / "one.tokens"
    path.write_bytes(tf.file_bytes(doc_ids, ids, 2))
    file = tf.TokenFile(np.memmap(path, np.uint8, "r"))
    file.check()
    assert [file.doc_id(i) for i in range(5)] == file.doc_ids().to_pylist() == doc_ids
    assert [file.ids(i).tobytes() for i in range(5)] == ids
    assert (file.find(-5), file.find(-4), file.find(2**63 - 1)) == (2, -1, 4)
    data = bytearray(path.read_bytes())
    data[tf.HEADER.size] ^= 1
    with pytest.raises(ValueError):
        tf.TokenFile(data).check()
    empty = tf.TokenFile(tf.file_bytes([], [], 4))
    assert (empty.n_docs, empty.find(3), len(empty.doc_ids())) == (0, -1, 0)


def expected(rows) -> list[tuple]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    coded = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
             for d, t in rows]
    for d, x in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


def rows_of(df) -> list[tuple]:
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()),
                  key=lambda r: r[1])


ODD = ["", None, " ", "\n\t ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "Straße ΣΣ oΣ",
       "é e ́", "x y z　w", "\x1c\x1f a\x85b", "it's they'll 'S 'LL", "1234 5a6",
       "你好 \U0001f600", "don 't \n'm", "\r\n\r a\r", "w" * 30_000, "İIı ﬁ ẞ"]


def test_plain_words_have_the_tokenizers_ids():
    """Words of Latin letters go through another library: known words, random ones, runs of one
    letter, joined words, and whatever stands between them."""
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder, rng = tf.TextIds("word_bpe_49k"), random.Random(1)
    letters = "etaoinshrdlucmfwypvbgkjqxzéèüßñÀÖÿ"
    words = [w.removesuffix("</w>") for w in full.get_vocab() if w.removesuffix("</w>").isalpha()]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(30_000)]
    words += [rng.choice(letters) * rng.randint(1, 90) for _ in range(3000)]
    words += [(rng.choice(words) + rng.choice(words))[:60] for _ in range(30_000)]
    rng.shuffle(words)
    for k in range(0, len(words), 500):
        text = "".join(w + rng.choice([" ", "\n", ", ", "'", "'s ", "7", " -- ", "''", "'LL"])
                       for w in words[k:k + 500])
        assert coder.ids(text) == np.array(
            full.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@pytest.mark.parametrize(("file_ids", "part_docs"), [(50, 4), (1 << 23, 20), (1 << 23, 8192)])
def test_documents(spark, file_ids, part_docs):
    rows = [(3 * i - 20, t) for i, t in enumerate(ODD * 3)]
    df = spark.createDataFrame([(*r, 1, "p", b"") for r in rows],
                               "doc_id long, text string, n int, path string, ids binary")
    assert rows_of(tf.token_files(df.repartition(7), file_ids=file_ids,
                                  part_docs=part_docs)) == expected(rows)


def test_repeated_and_missing_ids(spark, tmp_path):
    """Null ids first; they and a doc_id that is a third of all rows fill many parts."""
    rows = [(None, f"none {i % 7}") for i in range(300)] + [(4, "b"), (4, "a"), (4, "b")]
    rows += [(9, "same")] * 400 + [(100 + i, f"other {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tf.write_token_files(df, str(tmp_path / "out"), part_docs=30)
    got, want = rows_of(tf.read_token_files(spark, str(tmp_path / "out"))), expected(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert sorted(map(str, [(r[0], *r[2:]) for r in got])) == sorted(
        map(str, [(r[0], *r[2:]) for r in want]))
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "out/manifest"))
             .groupBy("part").agg({"n_docs": "sum"}).toDF("part", "n").collect()]
    assert max(sizes) < 100 and len(sizes) > 25


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tf.token_files(df).count() == 0


def test_only_files_of_the_manifest_count(spark, tmp_path):
    """What a lost or repeated task leaves behind is not read; sizes are bounded."""
    df = spark.createDataFrame([(i, "some words here " * 9) for i in range(300)],
                               "doc_id long, text string")
    folder = str(tmp_path / "out")
    manifest = tf.write_token_files(df, folder, file_ids=1000).collect()
    assert len(manifest) > 5 and all(m.n_ids <= 1000 for m in manifest)
    assert {os.path.basename(m.path) for m in manifest} == set(os.listdir(f"{folder}/data"))
    before = rows_of(tf.read_token_files(spark, folder))
    (tmp_path / "out/data/000000-0000-99999.tokens").write_bytes(b"half a file")
    assert rows_of(tf.read_token_files(spark, folder)) == before
    with open(manifest[0].path, "r+b") as f:
        f.seek(200)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="damaged"):
        tf.read_token_files(spark, folder).collect()


def test_query(spark, sf):
    from tripletspark.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_token_files"](spark, sf)) == expected(rows)
