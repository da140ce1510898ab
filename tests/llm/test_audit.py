"""The audit against counting every document in every order; retractions; recovery."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from tripletspark.llm import audit

SCHEMA = "doc_id long, text string, lang string, n long, part string, mask int"


def plain_masks(rows) -> list[tuple]:
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(ws) < 100)
        fails += "B" * (100 * len(set(ws)) < 80 * len(ws))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (d is not None and least[t] < d)
        out.append((d, lang or "", fails))
    return out


def plain(rows, labels) -> dict:
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    masks = plain_masks(rows)
    for part in {p for _, p, _ in masks}:
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(d, f) for d, p, f in masks if p == part]
            everything = list(left)
            for k, letter in enumerate(order, 1):
                removed = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                removed_by[letter] += len(removed)
                out[part, order, k] = [
                    len(left), len(removed),
                    sum(letter in f for _, f in everything) - len(removed),
                    sum(f == letter for _, f in everything),
                    sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed), letter]
        for (p, order, k), v in out.items():
            if p == part:
                v[6] = removed_by[order[k - 1]]
    return {k: tuple(v) for k, v in out.items()}


def as_dict(df) -> dict:
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails,
                                              r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def text(rng: random.Random) -> str:
    ws = [rng.choice(["aa", "Bb", "CC", "d"]) + str(rng.randrange(rng.choice([9, 10**6])))
          for _ in range(rng.choice([5, 99, 100, 101, 150]))]
    return rng.choice([" ", "\n", "  "]).join(ws) + rng.choice(["", "", "|", "$"])


def sample() -> tuple[list, list]:
    rng = random.Random(2)
    texts = [text(rng) for _ in range(60)] + ["", None, "   ", "Ä" * 9, "x " * 60_000]
    rows = [(rng.randrange(300), rng.choice(texts), rng.choice(["en", "de", None, ""]))
            for _ in range(400)]
    rows += [(i, texts[0], "en") for i in range(1000, 1300)]  # a third of all rows
    rows += [rows[3], rows[3], (None, texts[0], "en"), (None, "alone", "fr"), (-5, texts[0], "de")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 1200, 3)]
    return rows, labels + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]


def write(spark, rows, path, files) -> None:
    """Files in an order that brings smaller ids later."""
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else 0))
    for k in range(files):
        part = [(*r, 1, "p", 2) for r in rows[k::files]] if k % 2 else \
            [(*r, 1, "p", 2) for r in rows[k::files]][::-1]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize(("files", "rounds"), [(1, 4), (5, 5), (6, 2)])
def test_against_every_document(spark, tmp_path, files, rounds):
    rows, labels = sample()
    write(spark, rows, str(tmp_path / "docs"), files)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(spark, str(tmp_path / "docs"), lab, {"rounds": rounds})
    assert as_dict(got) == plain(rows, labels)


def test_smaller_ids_retract(spark, tmp_path):
    """Ids fall from file to file; each file takes back the counter that the last one raised, and
    files that come after a run are added to it."""
    path, work = str(tmp_path / "docs"), str(tmp_path / "work")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(9, "same text", "en")], "doc_id long, text string, lang string")
    one.write.parquet(path)
    counters = {(r.part, r.mask): r.n for r in
                audit.mask_counters(spark, path, lab, work=work).collect()}
    assert counters == {("en", 1): 1}
    for d, lang in ((5, "de"), (7, "fr"), (1, "fr"), (5, "de")):
        spark.createDataFrame([(d, "same text", lang)], one.schema).write.mode("append").parquet(path)
        got = {(r.part, r.mask): r.n for r in
               audit.mask_counters(spark, path, lab, work=work).collect()}
    assert got == {("en", 17): 1, ("de", 17): 2, ("fr", 17): 1, ("fr", 1): 1}
    changes = spark.read.parquet(f"{work}/changes/*")
    assert changes.where("n < 0").count() >= 2


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    rows, labels = sample()
    path, work = str(tmp_path / "docs"), str(tmp_path / "work")
    write(spark, rows, path, 6)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, calls = audit._change, []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 13:  # inside the third batch, after its state was stored
            raise RuntimeError("lost")
        return whole(*args, **kwargs)
    monkeypatch.setattr(audit, "_change", failing)
    with pytest.raises(StreamingQueryException):
        audit.mask_counters(spark, path, lab, rounds=6, work=work)
    got = audit.interactions(audit.mask_counters(spark, path, lab, rounds=6, work=work))
    assert as_dict(got) == plain(rows, labels)


def test_empty_table(spark, tmp_path):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "docs"))
    assert audit.filter_audit(spark, str(tmp_path / "docs"), lab).count() == 0
