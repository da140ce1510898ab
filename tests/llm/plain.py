"""Plain versions of what the operators compute, one text at a time."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf: str, extra: list[tuple] = ()):
    """The given documents and some rows more, with columns whose names could clash."""
    from pyspark.sql import functions as F
    given = spark.read.parquet(f"{sf}/documents.parquet")
    if extra:
        more = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in extra],
                                     given.schema)
        given = given.union(more)
    return given.withColumn("line", F.lit("x")).withColumn("_c0", F.lit(1)).withColumn(
        "digest", F.lit("y")).withColumn("removed", F.lit(2))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def joined(spans: list[tuple[int, int, int]], kinds: tuple) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


PII = ("email", "ip", "card", "phone")


def pii(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (pattern, fits) in enumerate((
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             lambda m: all(int(p) <= 255 for p in m.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19
             and luhn(d)),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if fits(m[0])]
    return out


def counts(text: str) -> dict:
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dups,
            "n_repeat_words": len(covered)}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
