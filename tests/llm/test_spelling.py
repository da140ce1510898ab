"""Words, near words, forms and roots against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.plain import edit_distance
from tripletspark.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyzàéßÿ"


def plain_words(rows, one_in, min_chars=6, min_count=5) -> dict[str, int]:
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def plain(words: dict[str, int], ratio=5) -> dict[str, tuple]:
    near = {w: [] for w in words}
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if abs(len(a) - len(b)) < 2 and edit_distance(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def edited(rng: random.Random, word: str) -> str:
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(LETTERS) + word[at:],
                       word[:at] + rng.choice(LETTERS) + word[at + 1:]])


def as_dict(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("group", [2, 5, 32])
def test_words_against_brute_force(spark, group):
    """Chains of edits, runs of one letter, words with one common half, repeated letters; small
    groups make keys split down to single letters."""
    rng = random.Random(group)
    words = {}
    for _ in range(25):
        word = "".join(rng.choice(LETTERS[:8]) for _ in range(rng.randint(6, 14)))
        n = rng.randint(2000, 60_000)
        for _ in range(6):
            words.setdefault(word, n)
            word, n = edited(rng, word), max(5, n // rng.choice([1, 4, 5, 6]))
    for _ in range(120):  # all under the keys of one front half, and of one back half
        words["common" + "".join(rng.choice("ab") for _ in range(6))] = rng.randint(5, 500)
        words["".join(rng.choice("ab") for _ in range(6)) + "common"] = rng.randint(5, 500)
    for n in range(6, 14):
        words["a" * n] = 5 ** (16 - n)
        words["a" * (n - 1) + "b"] = 7
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got, want = as_dict(spelling.group_variants(df, group=group)), plain(words)
    assert got == want
    assert sum(v[3] > 0 for v in want.values()) > 100
    assert any(want[v[0]][0] for v in want.values() if v[0])  # chains


def test_hot_key_is_split(spark):
    """A third of all words share their front half: no key keeps more than the alphabet."""
    rng = random.Random(1)
    words = {"hotkeyhotkey" + "".join(rng.choice(LETTERS) for _ in range(12)): 5
             for _ in range(1500)}
    words |= {"".join(rng.choice(LETTERS) for _ in range(24)): 5 for _ in range(1500)}
    planted = list(words)[:50]
    words |= {w[:-1] + ("z" if w[-1] != "z" else "y"): 50 for w in planted}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    links = {frozenset((r.a, r.b)) for r in spelling.near_links(df).collect()}
    assert {frozenset((w, w[:-1] + ("z" if w[-1] != "z" else "y"))) for w in planted} <= links
    plan = spelling.near_links(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_documents(spark):
    rng = random.Random(3)
    base = ["Straßen", "Études", "études", "running", "runing", "hello", "x" * 3000]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) + "×end1two")
            for i in range(120)]
    rows += [(5, rows[5][1]), (None, "running " * 30), (7, None), (8, ""), (9, "!? 12"),
             (10, "y" * 200_000 + " " + ("x" * 2999 + "z ") * 5)]
    df = spark.createDataFrame([(*r, "w", 3) for r in rows],
                               "doc_id long, text string, word string, n int")
    for one_in in (7, 199, None):
        got = as_dict(spelling.spelling_variants(df, spoil=one_in))
        assert got == plain(plain_words(rows, one_in))
    assert spelling.spelling_variants(df.limit(0), spoil=199).count() == 0
    assert spelling.spelling_variants(df.where("doc_id = 9")).count() == 0


def test_query(spark, sf):
    from tripletspark.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_dict(QUERIES["op13_spelling"](spark, sf)) == plain(plain_words(rows, 199))
