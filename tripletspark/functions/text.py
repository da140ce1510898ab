"""Column expressions over text. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space (Unicode, not only ASCII), the UUID namespace
# for DNS names, and the leading-comment patterns.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
C_HEADER = r"(?s)^\s*/\*(.*?)\*/(.*)$"
HTML_HEADER = r"(?s)^\s*<!--(.*?)-->(.*)$"
_EDGE_SPACE = r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(_col(c), _EDGE_SPACE, "")


def clean_whitespace(c: Column | str) -> Column:
    """Collapse every run of white space to one space and strip; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), WHITESPACE, " "))


def is_blank(c: Column | str) -> Column:
    return clean_whitespace(c) == ""


def split_header(c: Column | str, pattern: str = C_HEADER) -> tuple[Column, Column]:
    """(header, body): only a comment at the very start of the text is a header."""
    c = _col(c)
    found = c.rlike(pattern)
    header = F.when(found, strip(F.regexp_extract(c, pattern, 1))).otherwise(F.lit(""))
    body = F.when(found, strip(F.regexp_extract(c, pattern, 2))).otherwise(strip(c))
    return header, body


#: Scheme and host of a path, as in file:/a, file:///a, hdfs://host:8020/a.
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)"


def parse_path(path: Column | str, root: str) -> Column:
    """Struct (author, cohort, site) from the first directory below ``root``.

    The directory name is dash-separated; any missing part makes all three 'ERROR'. Scheme and
    host of either side don't count, so the root given to a scan fits the paths it returns.
    """
    bare = F.regexp_replace(_col(path), _SCHEME, "")
    root = re.sub(_SCHEME, "", root).rstrip("/")
    inside = F.regexp_replace(bare, "^" + _quote(root) + "/*", "")
    first = F.when(F.instr(inside, "/") > 0, F.substring_index(inside, "/", 1)).otherwise("")
    parts = F.split(first, "-")
    after = F.try_element_at(F.split(first, "cpoolday"), F.lit(2))
    author = F.try_element_at(F.split(after, "-"), F.lit(2))
    site = F.try_element_at(parts, F.lit(4))
    tagged = F.filter(parts, lambda p: p.startswith("cpoolday"))
    cohort = F.coalesce(F.try_element_at(tagged, F.lit(1)), F.lit("unknown"))
    bad = author.isNull() | site.isNull()
    error = F.lit("ERROR")
    return F.struct(
        F.when(bad, error).otherwise(author).alias("author"),
        F.when(bad, error).otherwise(cohort).alias("cohort"),
        F.when(bad, error).otherwise(site).alias("site"),
    )


def parse_with_pattern(path: Column | str, pattern: str, names: Sequence[str]) -> Column:
    """``parse_path`` for other layouts: one regular-expression group per name."""
    path = _col(path)
    found = path.rlike(pattern)
    return F.struct(*[
        F.when(found, F.regexp_extract(path, pattern, i + 1)).otherwise("ERROR").alias(n)
        for i, n in enumerate(names)
    ])


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E" if text else ""


def pseudonymize(c: Column | str, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID (version 5): the same name always gives the same id."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), _col(c).cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def assign_id(*cols: Column | str) -> Column:
    """Row id from content. A random id would change whenever Spark recomputes a task."""
    digests = [F.sha2(F.coalesce(_col(c).cast("string"), F.lit("")), 256) for c in cols]
    return pseudonymize(F.concat_ws("/", *digests))


def truncate_chars(c: Column | str, n: int, suffix: str = "") -> Column:
    cut = F.substring(_col(c), 1, n)
    return F.concat(cut, F.lit(suffix)) if suffix else cut


# Prefixes by model family, first match wins.
PREFIXES = (
    ("bge", "Represent this query for retrieving relevant documents: ",
     "Represent this document for retrieval: "),
    ("e5", "query: ", "passage: "),
    ("gemma", "query: ", "passage: "),
)


def instruction_prefix(text: Column | str, model: Column | str, role: Column | str) -> Column:
    """Put the model family's query or passage prefix before the text.

    ``model`` and ``role`` are columns; pass ``F.lit`` for constants.
    """
    name, role = F.lower(_col(model)), _col(role)
    prefix = None
    for family, query, passage in PREFIXES:
        choice = (F.when(role == "query", query).when(role == "passage", passage).otherwise(""))
        hit = name.contains(family)
        prefix = F.when(hit, choice) if prefix is None else prefix.when(hit, choice)
    return F.concat(prefix.otherwise(""), _col(text))


def system_and_user(template: str, text: Column | str) -> Column:
    """Two messages: the template as system, the input column as user."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(template).alias("content")),
        F.struct(F.lit("user").alias("role"), F.coalesce(_col(text), F.lit("")).alias("content")),
    )


def single_user(template: str, fields: Mapping[str, Column | str]) -> Column:
    """One user message with every ``{name}`` of the template filled from a column.

    The template is split at its placeholders, so text that itself holds ``{...}`` is
    never substituted a second time.
    """
    return F.array(F.struct(
        F.lit("user").alias("role"), fill_template(template, fields).alias("content")))


def fill_template(template: str, fields: Mapping[str, Column | str]) -> Column:
    pieces: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in fields]
        spots = sorted(s for s in spots if s[0] >= 0)
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = spots[0]
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(_col(fields[name]).cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")


JUDGE_INSTRUCTIONS = (
    "You review feedback about code. Decide whether the principle it teaches is right, "
    "clearly put and applicable to similar code. Generic wording is no fault. Answer with "
    "one JSON object with the keys quality_score, is_factually_correct, "
    "is_conceptually_clear, is_applicable, issues, needs_correction, corrected_feedback."
)


def judge_messages(code: Column | str, feedback: Column | str, kind: str) -> Column:
    """The messages of one review: fixed instructions, then the code and the feedback."""
    user = F.concat(
        F.lit(f"Review this {kind}.\n\nCode:\n"), F.coalesce(_col(code), F.lit("")),
        F.lit("\n\nFeedback:\n"), F.coalesce(_col(feedback), F.lit("")))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(JUDGE_INSTRUCTIONS).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


VERDICT = T.StructType([
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("is_factually_correct", T.BooleanType()),
    T.StructField("is_conceptually_clear", T.BooleanType()),
    T.StructField("is_applicable", T.BooleanType()),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("needs_correction", T.BooleanType()),
    T.StructField("corrected_feedback", T.StringType()),
])


def unfence(response: Column | str) -> Column:
    """The part inside a ```json fence, else inside any fence, else the whole text."""
    response = _col(response)
    tagged = F.split(F.element_at(F.split(response, "```json", 2), -1), "```", 2)[0]
    plain = F.split(F.element_at(F.split(response, "```", 2), -1), "```", 2)[0]
    return (F.when(response.contains("```json"), strip(tagged))
            .when(response.contains("```"), strip(plain))
            .otherwise(response))


def failed_verdict(issue: Column | str) -> Column:
    issue = F.lit(issue) if isinstance(issue, str) else issue
    return F.struct(
        F.lit(0.0).alias("quality_score"),
        F.lit(False).alias("is_factually_correct"),
        F.lit(False).alias("is_conceptually_clear"),
        F.lit(False).alias("is_applicable"),
        F.array(issue).alias("issues"),
        F.lit(True).alias("needs_correction"),
        F.lit("").alias("corrected_feedback"),
    ).cast(VERDICT)


def parse_judgement(response: Column | str) -> Column:
    """Verdict struct; text that is no JSON object becomes a zero-score verdict."""
    raw = unfence(response)
    is_object = F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>").isNotNull()
    return (F.when(F.coalesce(is_object, F.lit(False)), F.from_json(raw, VERDICT))
            .otherwise(failed_verdict("JSON parsing failed")))


def extract_json(c: Column | str, path: str) -> Column:
    return F.get_json_object(_col(c), path)


def similarity_band(sim: Column | str) -> Column:
    sim = _col(sim)
    return F.when(sim > 0.6, "high").when(sim > 0.4, "medium").otherwise("low")


def result_badge(score: Column | str) -> Column:
    score = _col(score)
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def quality_grade(mean_sim: Column | str) -> Column:
    """Grade of a dataset by the mean similarity of positives to their negatives."""
    mean_sim = _col(mean_sim)
    return F.when(mean_sim > 0.6, "bad").when(mean_sim > 0.5, "medium").otherwise("good")
