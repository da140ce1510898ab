from __future__ import annotations

import random

import numpy as np

from tests.llm import plain
from tripletspark.llm import decontaminate as dec


def plain_score(item: list[str], text: list[str]) -> int:
    best, row = 0, [0] * (len(text) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_against_plain(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(1, 15))],
              [rng.choice("abcde") for _ in range(rng.randint(1, 40))]) for _ in range(300)]
    code = lambda w: np.array([ord(c) for c in w], np.uint64)
    got, _ = dec.align([code(a) for a, _ in pairs], [code(b) for _, b in pairs])
    assert got.tolist() == [plain_score(a, b) for a, b in pairs]


def test_hashes():
    words, bounds = dec.word_hashes(["One, two", "", "é!two TWO", " "])
    assert bounds.tolist() == [0, 2, 2, 5, 5]
    assert words[1] == words[3] == words[4] != words[0] and len(set(words.tolist())) == 3
    h, at = dec.ngram_hashes(*dec.word_hashes(["a b c d e", "a b c", "z b c d e"]))
    assert at.tolist() == [0, 1, 8, 9] and h[1] == h[3] and h[0] != h[2]


def test_leaks_are_found_and_clean_documents_left(spark, sf):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "t", "la")]
    say = lambda n: [rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(n)]
    items = [say(rng.randint(20, 60)) for _ in range(30)]
    docs, want = [], set()
    for k, item in enumerate(items):
        docs.append((9000 + k, " ".join(say(200) + item + say(100)), "s"))
        edited = [w if rng.random() > 0.12 else "changed" for w in item]
        del edited[len(edited) // 2]
        docs.append((9100 + k, " ".join(say(50)) + "\n" + ", ".join(edited).upper(), "s"))
        want |= {(9000 + k, k), (9100 + k, k)}
    docs += [(9200 + k, " ".join(say(400)), "s") for k in range(40)]
    docs += [(9300, None, "s"), (9301, "", None), (9302, " ".join(items[3]), "s"),
             (9302, " ".join(items[3]), "s"), (None, " ".join(items[4]), "s"),
             (9303, " ".join(say(30_000) + items[5]), "s")]
    want |= {(9302, 3), (None, 4), (9303, 5)}
    bench = spark.createDataFrame(
        [(k, " ".join(x), 1) for k, x in enumerate(items)] + [(90, None, 1), (91, "", 1),
                                                              (92, "too short now", 1)],
        "item_id long, text string, doc_id int")
    df = plain.documents(spark, sf, docs).where("doc_id is null or doc_id >= 9000")
    got = dec.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    assert all(r.score == 1 for r in got if r.doc_id in range(9000, 9100))
    blocks = dec.contaminated(df, bench, block_chars=2000).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    left = dec.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {9200 + k for k in range(40)} | {9300, 9301}
    assert dec.contaminated(df, bench.limit(0)).count() == 0
    assert dec.contaminated(df.limit(0), bench).count() == 0


def test_every_document_with_every_item(spark):
    """The whole result on a small table against aligning everything with everything: copies,
    edits from none to most words, parts, two items in one text, an item said many times. What
    has no seed (four whole words in a row) is all that may be missing."""
    rng = random.Random(12)
    say = lambda n: [f"v{rng.randrange(300)}" for _ in range(n)]
    items = [say(rng.randint(8, 40)) for _ in range(12)]
    docs = [say(rng.randint(0, 120)) for _ in range(25)]
    for k, item in enumerate(items):
        for share in (0, 0.05, 0.15, 0.3, 0.5):
            edited = [w if rng.random() >= share else rng.choice(["", "x", f"v{rng.randrange(300)}"])
                      for w in item]
            docs.append(say(rng.randint(0, 60)) + [w for w in edited if w] + say(30))
        docs.append(item[:len(item) * 2 // 3] + say(20) + items[k - 1])
    docs.append((items[2] + say(1)) * 60)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)],
                               "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score * 2 * len(items[r.item_id]))
           for r in dec.contaminated(df, bench).collect()}
    want, seedless = {}, 0
    for i, d in enumerate(docs):
        runs = {tuple(d[a:a + 4]) for a in range(len(d) - 3)}
        for k, item in enumerate(items):
            score = plain_score(item, d)
            if score >= len(item) and score >= 2 * min(8, len(item)):
                if runs & {tuple(item[a:a + 4]) for a in range(len(item) - 3)}:
                    want[i, k] = score
                else:
                    seedless += 1
    assert got == want and len(want) > 60
    assert seedless <= 0.05 * len(want)


def test_memory_is_bounded_by_cells(spark):
    """An item said thousands of times is one stretch: it is cut into windows that hold every
    alignment, and few words are aligned together."""
    n, slack = 30, 8
    cut = list(dec.windows((0, 0, 100, 90_100), n, slack))
    assert cut[0][2] == 100 and cut[-1][3] == 90_100
    assert all(b[2] <= a[3] - 3 * n for a, b in zip(cut, cut[1:], strict=False))
    assert max(c[3] - c[2] for c in cut) <= 4 * (3 * n + 2 * slack)
    parts = list(dec.batches_of(cut * 256))
    assert sum(map(len, parts)) == 256 * len(cut)
    assert max(len(p) * max(c[3] - c[2] for c in p) for p in parts) <= dec.CELLS
    item = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, (item + " pause ") * 3000), (2, "clean " * 90_000)],
                               "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = dec.contaminated(df, bench).collect()
    assert [(r.doc_id, r.item_id, r.score, r.end_word) for r in got] == [(1, 7, 1.0, n)]
