from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tripletspark.llm.pii import find_pii, pii_report, redact

EDGES = ["", None, " ", "a@b.c+d@e.f, x@y z@.w q@-.-", "1.2.3.4.5 256.1.1.1 0001.2.3.255 1.2.3",
         "4111 1111 1111 1111-2 and 4111-1111-1111-1111", "+1 (456) 555-2186 +12 +123 +1+2345678901",
         "é ü 😀 mail me@x.org 4041894974608795", "@@@@ .@. ++++ +1......", "1" * 3000 + ".2.3.4",
         "a" * 60_000, "x@" + "a." * 20_000 + "b", "5 - 5 5  5", "+1 2\n3456 78901",
         "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32",
         "dni 12345678Z 12345678A", "ſecret K@k.k １２３４"]


def test_against_plain_patterns(spark, sf):
    docs = plain.documents(spark, sf, [(9000 + i, t, "s") for i, t in enumerate(EDGES)]
                           + [(9000, "", "s"), (None, "a@b.cd", None)])
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(d), plain.sha(plain.joined(found := plain.pii(t), plain.PII)),
                   *[sum(k == n for _, k, _ in found) for n in range(4)]) for d, t in texts)
    rows = pii_report(docs).collect()
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone)
                 for r in rows)
    assert got == want
    text_of = dict(texts)
    for r in rows:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [s for s in spans if s[0] in plain.PII]
        if r.doc_id in text_of:
            own = [":".join(s) for s in base]
            assert ",".join(own) == plain.joined(plain.pii(text_of[r.doc_id]), plain.PII)
    assert pii_report(docs.limit(0)).count() == 0


def test_checked_numbers_and_context(spark):
    df = spark.createDataFrame([(1, EDGES[-3]), (2, EDGES[-2]), (3, "87654321X sample"),
                                (4, "card 4111111111111111"), (5, "4111111111111111 sample")],
                               "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.m, x.score) for x in r.found] for r in find_pii(df).collect()}
    assert [x[:2] for x in got[1]] == [("iban", "DE89370400440532013000"),
                                       ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert [x[:2] for x in got[2]] == [("national", "12345678Z")]
    assert got[3] == []
    assert got[4][0][2] > got[5][0][2]


def test_redacted(spark):
    df = spark.createDataFrame([(1, "é a@b.cd and 1.2.3.4!"), (2, "nothing"), (3, None)],
                               "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    assert got == {1: "é [email] and [ip]!", 2: "nothing", 3: ""}


@pytest.mark.parametrize("kind", ["email", "ip"])
def test_linear_forms_match_the_plain_ones(spark, kind):
    import random
    from tripletspark.llm.pii import RULES, spans_of
    rng = random.Random(3)
    plain_form = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                  "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}[kind]
    rows = [(i, "".join(rng.choice("a1.@-+ é") for _ in range(40))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.x] for r in df.select(
        "doc_id", spans_of(F.col("text"), RULES[kind][0], RULES[kind][1]).alias("x")).collect()}
    assert got == {i: [m.span() for m in re.finditer(plain_form, t)] for i, t in rows}


def test_account_numbers_end_at_their_countrys_length(spark):
    """What follows a number behind a blank is no part of it; so are two numbers in a row."""
    gb, de, spaced = "GB82WEST12345698765432", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    rows = {f"pay to {gb} Thanks": [gb], f"{spaced} For": [spaced], f"{de} BIC COBADEFF": [de],
            f"{de} 12 items": [de], f"{de} {gb} {spaced}": [de, gb, spaced], f"{de}1": [],
            "NO9386011117947 A": ["NO9386011117947"], "DE89370400440532013001 X": []}
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {r.text: [x.m for x in r.found if x.kind == "iban"] for r in find_pii(df).collect()}
    assert got == rows
