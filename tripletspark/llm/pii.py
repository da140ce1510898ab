"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Only built-in functions: two regular-expression passes a kind, and only over texts that hold
the kind's characters. A text's own spans are folded within its row, nothing is shuffled.

Patterns use possessive quantifiers, and a lookbehind where a run of characters could be entered
at any of its places: they match what the plain forms match, in linear time and without
recursion, however long a run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import texts

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = (f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++")
IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?+[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: Characters of an account number by its country (the registry's fixed lengths).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 33: "LC RU"}
_COUNTRIES = {n: codes.replace(" ", "|") for n, codes in IBAN_LENGTHS.items()}
_BY_LENGTH = "|".join(f"(?:{c})[0-9]{{2}}(?:\\x20?+[A-Z0-9]){{{n - 4}}}"
                      for n, c in _COUNTRIES.items())
#: A known country's number ends at its length, whatever follows behind a blank; others run on.
IBAN = (f"(?<![A-Za-z0-9])(?:{_BY_LENGTH}|(?!{'|'.join(_COUNTRIES.values())})"
        "[A-Z]{2}[0-9]{2}(?:\\x20?+[A-Z0-9]){11,30}+)(?![A-Za-z0-9])")
NATIONAL = "(?<![A-Za-z0-9])[0-9]{8}[A-Z](?![A-Za-z0-9])"

_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Check letters of an eight-digit national number, by its remainder by 23 (fixed values).
NATIONAL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national")
KINDS = BASE + ADDED
#: The score of a confirmed span without context, by kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.3}
#: Words that speak for a kind when they stand nearby.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "(?:^|[^a-z])ip(?:[^a-z]|$)|address|server|host|client",
    "card": "card|visa|credit|payment|master",
    "phone": "phone|call|(?:^|[^a-z])tel(?:[^a-z]|$)|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "national": "(?:^|[^a-z])(?:dni|nif)(?:[^a-z]|$)|passport|identi",
}
#: Words that speak against any kind.
AGAINST = "example only|sample|dummy|version|placeholder"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of ASCII digits passes the Luhn checksum."""
    def step(acc: Column, digit: Column) -> Column:
        d = digit.cast("int") * F.when(acc["twice"], 2).otherwise(1)
        return F.struct((acc["total"] + d - F.when(d > 9, 9).otherwise(0)).alias("total"),
                        (~acc["twice"]).alias("twice"))
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("twice"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda a: a["total"] % 10 == 0)


def mod97(match: Column) -> Column:
    """True if an account number's rearranged digits leave 1 by 97."""
    bare = F.regexp_replace(match, "\\x20", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step, lambda a: a == 1)


def _letter_fits(match: Column) -> Column:
    at = F.substring(match, 1, 8).cast("int") % 23 + 1
    return F.substring(F.lit(NATIONAL_LETTERS), at, F.lit(1)) == F.substring(match, 9, 1)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


RULES = {
    "email": (EMAIL, "@", lambda m: F.lit(True)),
    "ip": (IP, "[0-9]\\.[0-9]", lambda m: m.rlike(f"^(?:{_PART}\\.){{3}}{_PART}$")),
    "card": (CARD, "[0-9][\\x20-]?[0-9]",
             lambda m: F.when(_between(F.length(_digits(m)), 14, 19), luhn(_digits(m)))
             .otherwise(False)),
    "phone": (PHONE, "\\+[0-9]", lambda m: _between(F.length(_digits(m)), 10, 15)),
    "iban": (IBAN, "[A-Z]{2}[0-9]{2}", mod97),
    "national": (NATIONAL, "[0-9]{8}[A-Z]", _letter_fits),
}

_SPANS = "array<struct<s:int,e:int,m:string>>"


def spans_of(text: Column, pattern: str, hint: str) -> Column:
    """Every match of ``pattern`` with its code-point range. The pieces between the matches and
    the matches give the places by adding up their lengths. ``hint`` is found in any text that
    has a match."""
    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))
        return F.when(x["m"].isNull(), acc).otherwise(
            F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out")))
    empty = F.array().cast(_SPANS)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step,
                        lambda a: a["out"])
    return F.when(text.rlike(hint), found).otherwise(empty)


def _score(kind: str, text: Column, x: Column, reach: int) -> Column:
    start = F.greatest(x["s"] - reach, F.lit(0))
    near = F.lower(F.concat(F.substring(text, start + 1, x["s"] - start), F.lit(" "),
                            F.substring(text, x["e"] + 1, F.lit(reach))))
    score = (F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.3).otherwise(0.0)
             - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def _confirmed(k: int, kind: str, min_score: float, reach: int) -> Column:
    """The spans of a kind that pass its validator, scored."""
    fits, text = RULES[kind][2], F.col("text")
    scored = F.transform(
        F.filter(F.col(f"_{kind}"), lambda x: fits(x["m"])),
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"),
            _score(kind, text, x, reach).alias("score"), x["m"].alias("m")))
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= min_score)


def _count(k: int, kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["k"] == k)).cast("long").alias(f"n_{kind}")


def find_pii(docs: DataFrame, min_score: float = 0.5, reach: int = 40) -> DataFrame:
    """doc_id, text and ``found``: array of (s, k, e, kind, score, m), by start, then kind.

    Spans of the base kinds stay whatever their score; those of ``ADDED`` need ``min_score``.
    Null text: empty, no spans. Every row gives one row, repeated rows too.
    """
    df = texts(docs)
    for kind in KINDS:
        pattern, hint, _ = RULES[kind]
        df = df.withColumn(f"_{kind}", spans_of(F.col("text"), pattern, hint))
    parts = [_confirmed(k, kind, min_score, reach) for k, kind in enumerate(KINDS)]
    return df.select("doc_id", "text", F.sort_array(F.concat(*parts)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, all spans, their scores."""
    found = find_pii(docs, **options)
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    counts = [_count(k, kind) for k, kind in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",")
        .alias("scores"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets. Of spans that
    overlap, the first hides those that begin inside it."""
    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring(acc["text"], acc["at"] + 1, x["s"] - acc["at"]),
                         F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["s"] < acc["at"], acc).otherwise(
            F.struct(acc["text"].alias("text"), x["e"].alias("at"),
                     F.concat(acc["out"], F.array(piece)).alias("out")))
    start = F.struct(F.col("text"), F.lit(0).alias("at"),
                     F.array().cast("array<string>").alias("out"))
    cut = F.aggregate("found", start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(a["text"], a["at"] + 1, F.char_length(a["text"]))))
    return find_pii(docs, **options).select("doc_id", cut.alias("text"))
