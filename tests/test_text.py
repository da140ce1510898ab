from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tripletspark.functions import text as tx


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr.alias("x")).first().x


@pytest.mark.parametrize("text, header, body", [
    ("/* h */\nint x;\n", "h", "int x;"),
    ("int x; /* c */ y", "", "int x; /* c */ y"),
    ("/* open int x;", "", "/* open int x;"),
    (" /* a */ b", "", "/* a */ b"),
    (" \n/* a\nb */ c \r\n", "a\nb", "c"),
    ("/**/", "", ""),
    ("", "", ""),
])
def test_split_header(spark, text, header, body):
    h, b = tx.split_header("c")
    assert one(spark, text, F.struct(h.alias("h"), b.alias("b"))) == (header, body)


@pytest.mark.parametrize("path, expected", [
    ("/r/p0-p1-p2-site-cpoolday05-alice-x/a/b.c", ("alice", "cpoolday05", "site")),
    ("/r/foo/x.c", ("ERROR",) * 3),
    ("/r/x.c", ("ERROR",) * 3),
    ("/r/a-b-c-site-noday-bob/x.c", ("ERROR",) * 3),
    ("/r/a-b-c-site-xcpoolday1-bob/x.c", ("bob", "unknown", "site")),
    ("/r/cpoolday01-eve/x.c", ("ERROR",) * 3),
])
def test_parse_path(spark, path, expected):
    assert tuple(one(spark, path, tx.parse_path("c", "/r"))) == expected


def test_parse_with_pattern(spark):
    p = tx.parse_with_pattern("c", r"//([^/]+)/(\w+)/", ["host", "lang"])
    assert one(spark, "http://h.example/en/1", p) == ("h.example", "en")
    assert one(spark, "nothing", p) == ("ERROR", "ERROR")


@pytest.mark.parametrize("name", ["abc", "", "é😀", "a b"])
def test_pseudonymize(spark, name):
    assert one(spark, name, tx.pseudonymize("c")) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_pseudonymize_known(spark):
    assert one(spark, "abc", tx.pseudonymize("c")) == "6cb8e707-0fc5-5f55-88d4-d4fed43e64a8"


@pytest.mark.parametrize("text", [
    "  a \t\n b  ", "", "   ", "a  b", "\x1ca\x85b\x0b", "x", "a  b", "　é😀 "])
def test_clean_whitespace_equals_python(spark, text):
    assert one(spark, text, tx.clean_whitespace("c")) == " ".join(text.split())


def test_clean_whitespace_null(spark):
    assert one(spark, None, tx.clean_whitespace("c")) == ""


def test_truncate_counts_code_points(spark):
    assert one(spark, "é😀xyz", tx.truncate_chars("c", 2)) == "é😀"
    assert one(spark, "ab", tx.truncate_chars("c", 100, "...")) == "ab..."


@pytest.mark.parametrize("model, role, expected", [
    ("BGE-m3", "query", "Represent this query for retrieving relevant documents: t"),
    ("bge", "passage", "Represent this document for retrieval: t"),
    ("x/multilingual-e5", "query", "query: t"), ("EmbeddingGemma", "passage", "passage: t"),
    ("minilm", "query", "t"), ("bge", "other", "t"),
    ("bge-e5", "query", "Represent this query for retrieving relevant documents: t"),
])
def test_instruction_prefix(spark, model, role, expected):
    assert one(spark, "t", tx.instruction_prefix("c", F.lit(model), F.lit(role))) == expected


def test_messages(spark):
    two = one(spark, "hi", tx.system_and_user("sys {c}", "c"))
    assert [(m.role, m.content) for m in two] == [("system", "sys {c}"), ("user", "hi")]
    # Text that looks like a placeholder is not filled a second time.
    single = one(spark, "{b}", tx.single_user("A{a}B{b}{x}", {"a": "c", "b": F.lit("!")}))
    assert [(m.role, m.content) for m in single] == [("user", "A{b}B!{x}")]


FAILED = ["JSON parsing failed"]


@pytest.mark.parametrize("answer, score, issues", [
    ('{"quality_score": 85, "issues": []}', 85.0, []),
    ('x ```json\n{"quality_score": 1.5}\n``` y', 1.5, None),
    ('```\n{"quality_score": 2, "issues": ["a"]}\n```', 2.0, ["a"]),
    ("no json", 0.0, FAILED), ("", 0.0, FAILED), ("[1]", 0.0, FAILED),
    ('{"quality_score": 3', 0.0, FAILED),
])
def test_parse_judgement(spark, answer, score, issues):
    v = one(spark, answer, tx.parse_judgement("c"))
    assert (v.quality_score, v.issues) == (score, issues)
    if issues == FAILED:
        assert v.needs_correction and not v.is_factually_correct and v.corrected_feedback == ""


def test_bands(spark):
    df = spark.createDataFrame([(0.6,), (0.61,), (0.4,), (0.41,)], "s double")
    assert [r.b for r in df.select(tx.similarity_band("s").alias("b")).collect()] == [
        "medium", "high", "low", "medium"]
    assert one(spark, 0.7, tx.result_badge("c"), "double") == "high"
    assert [one(spark, x, tx.quality_grade("c"), "double") for x in (0.61, 0.6, 0.5)] == [
        "bad", "medium", "good"]
