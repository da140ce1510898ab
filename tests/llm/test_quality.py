from __future__ import annotations

from collections import defaultdict

from tests.llm import plain
from tripletspark.llm.quality import apply_quality, quality_rules

BASE = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()


def normal(line: str) -> str:
    import re
    return re.sub("[0-9]+", "0", " ".join(plain.WORD.findall(line)).lower())


def verdicts(rows: list[tuple], max_docs: int, max_share: float, min_left: float) -> list[tuple]:
    """(doc_id, base_failed, kept, text left) of rows (doc_id, text, host)."""
    held, first, hosts = defaultdict(set), {}, defaultdict(set)
    for d, t, h in rows:
        hosts[h].add(d)
        for line in (t or "").split("\n"):
            if plain.WORD.search(line):
                held[h, normal(line)].add(d)
    for key, docs in held.items():
        first[key] = min((d for d in docs if d is not None), default=None)
    out = []
    for d, t, h in rows:
        own, gone = plain.counts(t or ""), 0
        lines = []
        for line in (t or "").split("\n"):
            key = (h, normal(line))
            n = len(held.get(key, ()))
            if n > max_docs and n > max_share * len(hosts[h]) and first[key] != d:
                gone += sum(map(len, plain.WORD.findall(line)))
            else:
                lines.append(line)
        failed = own["n_words"] < 50 or 100 * own["n_repeat_words"] > 50 * own["n_words"]
        kept = not failed and own["word_chars"] - gone >= min_left * own["word_chars"]
        out.append((d, *[own[c] for c in BASE], failed, kept, "\n".join(lines)))
    return out


def test_against_plain_rules(spark, sf):
    common = "Common line 7 of this host, with words enough."
    own = " ".join(f"w{i}" for i in range(60))
    extra = [(9000 + i, f"{own} {i}\n{common.replace('7', str(i))}\n\n{common.upper()}", "h1")
             for i in range(8)]
    extra += [(9100 + i, f"short {i}\n" + f"{common}\n" * 9, "h1") for i in range(6)]
    extra += [(9200, None, "h1"), (9201, "", None), (9202, " \t\n\x0b\x0c\r", "h1"),
              (9203, "a b c " * 40, "h2"), (9204, "\n".join([own] * 5), None),
              (9205, "é😀 " * 30_000, "h1"), (9206, "a b", None), (None, own, "h1"),
              (9000, extra[0][1], "h1")]
    docs = plain.documents(spark, sf, extra)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = verdicts(rows, 4, 0.001, 0.5)
    limits = {"max_docs": 4, "max_share": 0.001, "min_left": 0.5}
    got = quality_rules(docs, **limits).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, *[r[c] for c in BASE], r.base_failed, r.kept) for r in got],
                  key=key) == sorted([w[:-1] for w in want], key=key)
    assert any(not w[-2] and not w[-3] for w in want)  # some run dry
    left = apply_quality(docs, **limits)
    assert left.columns == docs.columns
    assert sorted([(r.doc_id, r.text, r.n_chars) for r in left.collect()], key=key) == sorted(
        [(w[0], w[-1], len(w[-1])) for w in want if w[-2]], key=key)
    # A filter on the result must not make the counts anew for every element.
    assert quality_rules(docs, **limits).where("not base_failed and n_repeat_words >= 0").count()
    assert quality_rules(docs.limit(0)).count() == 0
    assert apply_quality(docs.limit(0)).count() == 0
