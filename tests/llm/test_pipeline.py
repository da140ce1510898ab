"""The pipeline's stages against plain versions of what they must keep."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import plain


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
                    for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    clean = {i: "\n".join(words(rng, 40) for _ in range(4)) for i in range(40)}
    item = words(rng, 30)
    shared = words(rng, 60)
    rows = [(i, t, "en", "s0", len(t)) for i, t in clean.items()]
    rows += [(100 + i, clean[i], "en", "s1", 1) for i in range(5)]  # exact copies
    rows += [(200 + i, clean[i].replace(" ", " x ", 1), "en", "s1", 1) for i in range(5, 8)]
    one = words(rng, 400)  # a text of one line, and a near copy of it
    rows += [(300, one, "en", "s0", 1), (301, one + " end", "en", "s0", 1)]
    rows += [(400, words(rng, 90) + " " + item, "en", "s0", 1)]
    rows += [(500 + i, words(rng, 150) + "\n" + shared, "en", "s0", 1) for i in range(4)]
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0), (602, "too short", "en", "s0", 9),
             (None, words(rng, 80), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    originals = {*clean, 300, *range(500, 504), None}
    assert seen["quality"].keys() == {d for d, t, *_ in rows if t and len(t.split()) >= 50}
    assert seen["lines"].keys() == (originals | {301, 400})
    assert all(seen["lines"][d] == t for d, t in clean.items())
    assert sum(shared in (t or "") for t in seen["lines"].values()) == 1
    assert seen["near_duplicates"].keys() == originals | {400}
    assert seen["benchmark"].keys() == originals
    packed = {r.doc_id for r in docs.collect()}
    assert packed == originals
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))
    assert plain.counts(clean[0])["n_words"] == 160


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
