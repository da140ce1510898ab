"""The similarity join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tripletspark.llm import jaccard


def runs(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows: list[tuple]) -> set:
    """The doc_ids that stay."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [runs(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def changed(rng: random.Random, words: list[str], n: int) -> str:
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.mark.parametrize("group", [2048, 3])
def test_links_near_the_threshold(spark, monkeypatch, group):
    """Pairs on both sides of 0.8, groups whose first text is not like all others, boilerplate,
    and keys of more texts than a block holds."""
    monkeypatch.setattr(jaccard.similar_links, "__defaults__", (5, 0.8, group))
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 150))]
        rows += [changed(rng, base, rng.randint(0, len(base) // 30)) for _ in range(4)]
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [shared + " " + " ".join(f"o{rng.randrange(9000)}" for _ in range(rng.randint(0, 40)))
             for _ in range(30)]
    rows += [None, "", "A b", "a  b", " "]
    rows += [f"{x} b c d e{y}" for x in ("a", "A", "a ", " A") for y in ("", " f", " f g")]
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in jaccard.drop_similar(df).collect()}
    assert got == brute(rows)
    assert 20 < len(got) < 110
    assert jaccard.drop_similar(df.limit(0)).count() == 0


def test_the_stage_finds_what_five_bits_miss(spark):
    """At a similarity of about 0.83, 5 equal-bit differences of 64 were hardly ever met."""
    rng = random.Random(6)
    rows = []
    for k in range(20):
        base = [f"x{k}y{i}" for i in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, changed(rng, base, 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == brute(rows) == set(range(0, 40, 2))


def test_candidates_of_a_template_grow_with_the_texts(spark, monkeypatch):
    """Texts that share 120 words and own 45 (similarity 0.56): none is a copy, and what they
    share is no key, so pairs do not grow with the square of their number. Those that own too
    few words for that still link exactly."""
    counted = []
    for name in ("_possible", "_met"):
        def counting(*args, whole=getattr(jaccard, name)):
            counted.append(args[0].count())
            return whole(*args)
        monkeypatch.setattr(jaccard, name, counting)
    shared = " ".join(f"s{i}" for i in range(120))
    pairs = []
    for n in (100, 400):
        rows = [(i, shared + " " + " ".join(f"o{i}x{k}" for k in range(45))) for i in range(n)]
        counted.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert jaccard.drop_similar(df).count() == n
        pairs.append(sum(counted))
    assert pairs[1] <= 8 * max(pairs[0], 100)


def test_edge_rows(spark):
    """Null doc_ids, repeated rows, a very long text, names that the join uses itself."""
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (7, "a b c d e f", 3),
            (7, "a b c d e f", 4), (None, None, 5), (8, "  ", 6), (9, long, 7),
            (10, long.replace("w5 ", "v5 "), 8), (None, "only without an id", 9)]
    df = spark.createDataFrame([(*r, "k", 0, 1) for r in rows],
                               "doc_id long, text string, n int, key string, root int, a int")
    got = jaccard.drop_similar(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [
        (False, 7), (False, 8), (False, 9), (True, 0)]


def test_no_possible_pair_is_ruled_out_by_parities():
    """Pairs of sets around the threshold, in blocks of every kind: all that reach it are handed
    on, and few that are far from it."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(-2**63, 2**63 - 1, int(rng.integers(20, 90)), np.int64)
        for _ in range(5):
            own = base.copy()
            at = rng.choice(len(own), int(rng.integers(0, len(own) // 7)), replace=False)
            own[at] = rng.integers(-2**63, 2**63 - 1, len(at), np.int64)
            sets.append(np.unique(own))
    near, far = set(), 0
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            if common >= 0.8 * (len(x) + len(sets[j]) - common) - 1e-9:
                near.add((j, i))
            far += common == 0
    assert len(near) > 80

    def batch(rows):
        key, i, j, side, docs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(i), pa.array(j), pa.array(side),
             pa.array(docs, pa.int64()), pa.array([len(sets[d]) for d in docs], pa.int64()),
             pa.array(docs, pa.int64()),
             pa.array([jaccard.parities(sets[d]) for d in docs], pa.list_(pa.int64()))],
            names=["key", "i", "j", "side", "doc", "n", "root", "odd"])
    whole = [(5, 0, 0, 0, d) for d in range(len(sets))]
    dealt = sorted((5, min(d % 3, k), max(d % 3, k), int(d % 3 > k), d)
                   for d in range(len(sets)) for k in range(3))
    for rows in (whole, dealt):
        cuts = [batch(rows[k:k + 37]) for k in range(0, len(rows), 37)]
        got = {(a.as_py(), b.as_py()) for out in jaccard._meet(0.8)(iter(cuts))
               for a, b in zip(out.column(0), out.column(1), strict=True)}
        assert near <= got
        assert len(got) < len(near) + 0.05 * far


def test_links_of_fingerprints_come_first_and_are_confirmed(spark, monkeypatch):
    """The stage asks SimHash for candidates; those below the threshold are no links."""
    asked = []
    whole = jaccard._by_fingerprint

    def wrong_too(own, width):
        asked.append({tuple(sorted((r.a, r.b))) for r in whole(own, width).collect()})
        ids = [r.digest for r in own.select("digest").distinct().collect()]
        return whole(own, width).union(spark.createDataFrame(
            [(min(ids), x) for x in ids if x != min(ids)], "a long, b long"))
    monkeypatch.setattr(jaccard, "_by_fingerprint", wrong_too)
    base = [f"w{i}" for i in range(900)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "more"])), (2, "quite another text"),
            (3, " ".join(f"z{i}" for i in range(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.drop_similar(df).collect()} == {0, 2, 3}
    assert len(asked) == 1 and len(asked[0]) >= 1
