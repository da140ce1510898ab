"""URL filters: rules by host and path, and for the rest a naive Bayes score of segmented names.

Host names run words together. A unigram model (word counts over all page texts) splits each
distinct label by Viterbi: only substrings of labels meet the counts, in one join, so neither
side needs a bound. Multinomial naive Bayes then learns words of host and path from all pages
that a rule decides, and judges the pages that no rule fits.

Addresses are judged once each, by (host, path); counting and scoring are joins on tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletspark.session import broadcast_if_small, cut_lineage

#: (verdict, rule): the rule's host is what stands before its first slash.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
LONGEST_WORD = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = re.compile("<[^>]*>")
_WORD = re.compile("[a-z]{1,20}")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for addresses without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, ruling: the longest rule whose host is the site's or a parent's and
    whose path begins the site's. ``rules``: verdict, rule."""
    rules = rules.select(
        F.substring_index("rule", "/", 1).alias("parent"), "rule",
        F.col("verdict").alias("ruling"),
        F.expr("substring(rule, instr(rule, '/'))").alias("start"))
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(
        F.slice("labels", i, F.size("labels")), "."))
    wide = (sites.select("host", "path", labels.alias("labels"))
            .select("host", "path", F.explode(parents).alias("parent")))
    return (wide.join(broadcast_if_small(rules, 10_000), "parent")
            .where(F.col("path").startswith(F.col("start")))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruling")).alias("x"))
            .select("host", "path", "x.rule", "x.ruling"))


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word, n over all texts, markup left out; counted in each batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(_WORD.findall(_TAG.sub(" ", text).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()),
                                              pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])
    return (texts.select(F.coalesce(column, F.lit("")).alias(column))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a label; a word that was never counted costs a factor of ten per
    character, so known words win where they fit."""
    if not label:
        return []
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = label[start:end]
            n = counts.get(word, 0)
            p = math.log(n / total) if n else -math.log(total) - len(word) * math.log(10)
            options.append((best[start] + p, start))
        score, start = max(options)
        best.append(score)
        back.append(start)
    out, end = [], len(label)
    while end:
        out.append(label[back[end]:end])
        end = back[end]
    return out[::-1]


def segment_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for distinct labels. Each label meets the counts of its own substrings."""
    total = int(counts.agg(F.sum("n")).first()[0] or 0) + 1
    spots = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("label") - i + 1)),
            lambda n: F.substring(F.col("label"), i, n))))
    pieces = (labels.where(F.length("label") > 0)
              .select("label", F.explode(F.array_distinct(spots)).alias("word")))
    known = pieces.join(counts, "word").groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            split = [viterbi(label, dict(own or []), total)
                     for label, own in zip(labels, batch.column("known").to_pylist(),
                                           strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.string()), pa.array(split, pa.list_(pa.string()))],
                names=["label", "words"])
    return labels.join(known, "label", "left").select("label", "known").mapInArrow(
        run, "label string, words array<string>")


def site_tokens(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """host, path, n, token: segmented words of the host's labels and words of the path, one row
    each; digits count as ``#``."""
    labels = sites.select("host", "path", "n", F.explode(F.split("host", "[^a-z]+")).alias("label"))
    labels = labels.where(F.col("label") != "")
    split = cut_lineage(segment_labels(labels.select("label").distinct(), counts))
    hosts = (labels.join(split, "label")
             .select("host", "path", "n", F.explode("words").alias("word"))
             .select("host", "path", "n", F.concat(F.lit("h:"), "word").alias("token")))
    plain = F.regexp_replace(F.translate("path", _UPPER, _LOWER), "[0-9]+", " # ")
    paths = (sites.select("host", "path", "n", F.explode(F.split(plain, "[^a-z#]+")).alias("word"))
             .where(F.col("word") != "")
             .select("host", "path", "n", F.concat(F.lit("p:"), "word").alias("token")))
    return hosts.union(paths)


def token_weights(tokens: DataFrame, ruled: DataFrame) -> DataFrame:
    """token, weight: log odds of block against allow, by add-one counts over all ruled pages."""
    seen = (tokens.join(ruled.select("host", "path", "ruling"), ["host", "path"])
            .groupBy("token").agg(
                F.sum(F.when(F.col("ruling") == "block", F.col("n")).otherwise(0)).alias("bad"),
                F.sum(F.when(F.col("ruling") == "allow", F.col("n")).otherwise(0)).alias("good")))
    seen = cut_lineage(seen)
    bad, good, kinds = seen.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    shift = math.log(((good or 0) + kinds + 1) / ((bad or 0) + kinds + 1))
    return seen.select("token", (F.log((F.col("bad") + 1) / (F.col("good") + 1)) + shift)
                       .alias("weight"))


def judge_urls(pages: DataFrame, rules=RULES, text: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none fits), verdict,
    score (log odds of block by the tokens that ruled pages have; both classes equally likely
    beforehand) and decided_by.

    Where no rule fits, the verdict is block if the score is above zero; an address without
    known tokens, such as null, is allowed. Repeated rows give repeated results.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    sites = cut_lineage(own.groupBy("host", "path").agg(F.count("*").alias("n")))
    table = spark.createDataFrame(list(rules), "verdict string, rule string")
    ruled = cut_lineage(fitting_rule(sites, table))
    tokens = cut_lineage(site_tokens(sites, word_counts(pages, text)))
    weights = broadcast_if_small(token_weights(tokens, ruled))
    scores = (tokens.join(weights, "token").groupBy("host", "path")
              .agg(F.round(F.sum("weight"), 6).alias("score")))
    judged = sites.select("host", "path").join(ruled, ["host", "path"], "left").join(
        scores, ["host", "path"], "left")
    score = F.coalesce("score", F.lit(0.0))
    judged = judged.select(
        "host", "path", "rule", F.coalesce("ruling", F.when(score > 0, "block").otherwise("allow"))
        .alias("verdict"), score.alias("score"),
        F.when(F.col("rule").isNull(), "words").otherwise("rule").alias("decided_by"))
    return own.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", "verdict", "score", "decided_by")
