from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import plain
from tripletspark.llm import lines as ln


def variants(rng: random.Random, n: int, size: int) -> list[str]:
    letters = "abcdé "
    out = []
    for _ in range(n):
        base = "".join(rng.choice(letters) for _ in range(size + rng.randint(0, 8)))
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            out.append(ln.normal("".join(own)))
    return sorted(set(filter(None, out)))


def test_bit_parallel_distance():
    rng = random.Random(2)
    lines = variants(rng, 60, 12)
    code = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    for edits in (1, 2, 3):
        got = ln.within([code[i] for i, _ in pairs], [code[j] for _, j in pairs], edits)
        assert got.tolist() == [plain.edit_distance(lines[i], lines[j]) <= edits
                                for i, j in pairs]


def test_lines_within_the_threshold_share_a_key():
    rng = random.Random(3)
    lines = variants(rng, 80, 14)
    for edits in (1, 2, 3):
        keys = [ln.line_keys(s, edits) for s in lines]
        for i, a in enumerate(lines):
            for j, b in enumerate(lines[:i]):
                if plain.edit_distance(a, b) <= edits:
                    (ia, pa), (ib, pb) = keys[i], keys[j]
                    assert set(ia) & set(ib + pb) or set(ib) & set(pa)


def check(spark, sf, extra, **limits):
    docs = plain.documents(spark, sf, extra).where("doc_id is null or doc_id >= 9000")
    got = ln.line_classes(docs, **limits).collect()
    small, near = limits.get("min_chars", ln.MIN_CHARS), limits.get("near_chars", ln.NEAR_CHARS)
    rows = [(d, k, ln.normal(x)) for d, t in {(r.doc_id, r.text or "") for r in docs.collect()}
            for k, x in enumerate(t.split("\n")) if ln.normal(x)]
    known = sorted({x for _, _, x in rows if len(x) >= small})
    root = {x: x for x in known}
    links = dict.fromkeys(known, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(known):
        for b in known[:i]:
            if min(len(a), len(b)) >= near and abs(len(a) - len(b)) <= 2 and \
                    plain.edit_distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for d, k, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if x in root:
            first.setdefault(find(x), (d, k))
    want = {(d, k): (*first[find(x)], links[x], (d, k) == first[find(x)]) if x in root
            else (None, None, None, True) for d, k, x in rows}
    assert {(r.doc_id, r.pos): (r.class_doc, r.class_pos, r.n_links, r.kept)
            for r in got} == want
    return docs, {k for k, v in want.items() if v[-1]}


def test_classes_links_and_texts(spark, sf):
    rng = random.Random(5)
    pool = variants(rng, 40, 20)
    extra = [(9000 + i, "\n".join(rng.choice(pool) for _ in range(6)), "s") for i in range(40)]
    extra += [(9100, None, "s"), (9101, "", None), (9102, "\n \n\t", "s"), (9103, "ab\nab\nab", "s"),
              (9104, "y" * 2000 + "\n" + "y" * 1999, "s"), (9000, extra[0][1], "s"),
              (None, pool[0] + "\n" + pool[1].upper(), "s")]
    docs, kept = check(spark, sf, extra, min_chars=6, near_chars=10)
    left = ln.drop_repeated_lines(docs, min_chars=6, near_chars=10)
    assert left.columns == docs.columns
    seen = {}
    for r in docs.collect():
        parts = (r.text or "").split("\n")
        own = [x for k, x in enumerate(parts) if not ln.normal(x) or (r.doc_id, k) in kept]
        size = lambda xs: sum(len(ln.normal(x)) for x in xs)
        if size(own) >= 0.3 * size(parts):
            seen[r.doc_id] = r.text if len(own) == len(parts) else "\n".join(own)
    assert {r.doc_id: r.text for r in left.collect()} == seen
    assert ln.line_classes(docs.limit(0)).count() == 0
    assert ln.drop_repeated_lines(docs.limit(0)).count() == 0


def test_a_large_group_is_dealt_out(spark, sf, monkeypatch):
    """All lines share keys; blocks of a few lines give the same links and counts."""
    monkeypatch.setattr(ln, "GROUP", 7)
    stem = "the same long beginning of every line, number "
    extra = [(9000 + i, f"{stem}{i:03d}", "s") for i in range(0, 120, 3)]
    check(spark, sf, extra)


def test_keys_meet_in_one_count(spark):
    """A pair that shares several keys counts once."""
    df = spark.createDataFrame([(1, "a" * 60), (2, "a" * 61), (3, "a" * 62)],
                               "doc_id long, text string")
    rows = ln.line_classes(df.withColumn("key", F.lit(1))).collect()
    assert {(r.doc_id, r.n_links, r.class_doc) for r in rows} == {(1, 2, 1), (2, 2, 1), (3, 2, 1)}


def test_short_lines_have_a_class_and_links(spark):
    """By default every line has an exact class, and the edit join takes lines of 16 characters."""
    df = spark.createDataFrame(
        [(1, "are is anwh reenen.\n}\nabc"), (2, "are, is anwh reenen.\n}\nabd")],
        "doc_id long, text string")
    got = {(r.doc_id, r.pos): (r.class_doc, r.class_pos, r.n_links, r.kept)
           for r in ln.line_classes(df).collect()}
    assert got == {(1, 0): (1, 0, 1, True), (2, 0): (1, 0, 1, False),
                   (1, 1): (1, 1, 0, True), (2, 1): (1, 1, 0, False),
                   (1, 2): (1, 2, 0, True), (2, 2): (2, 2, 0, True)}
    left = {r.doc_id: r.text for r in ln.drop_repeated_lines(df, min_left=0.0).collect()}
    assert left == {1: "are is anwh reenen.\n}\nabc", 2: "}\nabd"}
