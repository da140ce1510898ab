"""Fingerprints and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tripletspark.llm import components as components_module
from tripletspark.llm import simhash
from tripletspark.llm.components import components


def plain_fingerprint(text: str, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles] if words else []
    return sum(1 << k for k in range(64)
               if hashes and 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(nodes: list[int], bits: int) -> dict[int, int]:
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def balls(n: int, bits: int, seed: int) -> list[int]:
    """Random fingerprints, each with others a few bits away."""
    rng = np.random.default_rng(seed)
    out = set()
    for x in rng.integers(0, 1 << 63, n, dtype=np.uint64):
        for _ in range(int(rng.integers(1, 6))):
            flips = rng.choice(64, int(rng.integers(0, 2 * bits)), replace=False)
            out.add(int(x) ^ sum(1 << int(k) for k in flips))
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 7])
def test_links_give_the_components_of_brute_force(spark, bits):
    nodes = balls(80, bits, bits)
    df = spark.createDataFrame([(simhash.signed(x),) for x in nodes], "fp long")
    got = {r.node: r.root for r in components(simhash.hamming_links(df, bits)).collect()}
    want = plain_components(nodes, bits)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    full = {simhash.signed(x): got.get(simhash.signed(x), simhash.signed(x)) for x in nodes}
    assert groups(full) == {frozenset(simhash.signed(x) for x in g) for g in groups(want)}


def test_large_groups_are_split_without_loss(spark):
    """Groups of one key, most of all fingerprints, beyond a bound of 4: split again and again,
    compared in the workers, with the components of brute force."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 63))
    nodes = sorted({center ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
                    for _ in range(60)} | set(balls(20, 3, 9)))
    df = spark.createDataFrame([(simhash.signed(x),) for x in nodes], "fp long")
    got = {r.node: r.root for r in
           components(simhash.hamming_links(df, 3, group=4, small=2)).collect()}
    want = plain_components(nodes, 3)
    many = {x for x in nodes if sum(want[y] == want[x] for y in nodes) > 1}
    assert set(got) == {simhash.signed(x) for x in many}
    for a in many:
        for b in many:
            same = got[simhash.signed(a)] == got[simhash.signed(b)]
            assert same == (want[a] == want[b])


def test_documents(spark):
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.upper()), (7, base.replace("w5x5 ", "zz ")), (1, "a b"),
            (2, None), (8, ""), (4, " \t\n"), (6, "a b"), (6, "a b"), (None, "lonely text here"),
            (10, "É è " * 3), (11, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows],
                               "doc_id long, text string, fp long, root string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {int(r.fingerprint, 16): None for r in got}
    want = plain_components(sorted(fps), 3)
    by_doc = {(d, plain_fingerprint(t)) for d, t in rows}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == by_doc
    for r in got:
        same = [x.doc_id for x in got
                if want[int(x.fingerprint, 16)] == want[int(r.fingerprint, 16)]]
        assert r.component_id == min((d for d in same if d is not None), default=None)
    kept = simhash.drop_near_duplicates(df, 3, 3).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root"}
    assert len(kept) == len({want[int(r.fingerprint, 16)] for r in got})
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.columns[0] == "doc_id" and empty.count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)],
                                  "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_rounds_over_few_links_are_one_task(spark, monkeypatch, most):
    """Few links or many: the components of brute force. Few are no longer shuffled in a round."""
    monkeypatch.setattr(components_module, "FEW", most)
    plans, cut = [], components_module.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)
    monkeypatch.setattr(components_module, "cut_lineage", seen)
    draw = random.Random(3)
    links = [(draw.randrange(90), draw.randrange(90)) for _ in range(50)]
    links += [(100 + i, 101 + i) for i in range(9)] + [(None, 5), (7, None), (8, 8)]
    root = {x: x for pair in links for x in pair if None not in pair and pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(root.items())
    assert len(plans) > 2 and all(("Exchange" in p) == (not most) for p in plans[1:])
    empty = components(spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0
