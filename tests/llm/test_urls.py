from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tripletspark.llm.urls import RULES, judge_urls, viterbi

URLS = ["https://WWW.Example.com/en/1", "http://example.com/en/x?y", "x://a.example.com/EN/1",
        "https://com/", "https://com", "https://telecom/x", "ftp://a.net/es/1#z", "http://net/fr/",
        "http://a.net?/fr/", None, "", "no scheme", "a://b://c/d", "://", "http:///p", "http://a.b.c",
        "http://cheappills.org/win", "http://É.net/es/é", "http://" + "a" * 3000 + ".org/x",
        "http://x.org/" + "p/" * 3000]


def parse(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host: str, path: str):
    fits = []
    for verdict, rule in RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))


def test_rules_and_verdicts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = spark.createDataFrame([(9000 + i, u, None) for i, u in enumerate(URLS + URLS[:3])],
                                 pages.schema)
    from pyspark.sql import functions as F
    both = pages.union(more).withColumn("host", F.lit("x")).withColumn("score", F.lit(1))
    rows = judge_urls(both).collect()
    assert len(rows) == both.count()
    urls = {r.page_id: r.url for r in both.collect()}
    for r in rows:
        host, path = parse(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        _, rule, verdict = rule_of(host, path)
        assert r.rule == rule
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
    assert judge_urls(both.limit(0)).count() == 0


def test_weights_against_plain_counts(spark):
    pages = spark.createDataFrame(
        [(1, "http://goodnews.com/a", "good news"), (2, "http://badnews.net/es/b", "bad news news"),
         (3, "http://badnews.net/es/c", ""), (4, "http://badfarm.org/zz", "farm"),
         (5, "http://goodfarm.org/zz", None)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(pages).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_viterbi():
    counts = {"cheap": 9, "pills": 5, "che": 2, "ap": 3, "pill": 4, "s": 1}
    assert viterbi("cheappills", counts, 24) == ["cheap", "pills"]
    assert viterbi("", counts, 24) == [] and "".join(viterbi("qqzz", counts, 24)) == "qqzz"


def test_scores_against_plain_naive_bayes(spark, sf):
    """Counts, segmentation and weights over the whole table, an address at a time."""
    pages = [(r.page_id, r.url, r.html)
             for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(9000 + i, u, "cheap pills <b>win</b> win") for i, u in enumerate(URLS)]
    words = Counter()
    for _, _, html in pages:
        words.update(re.findall("[a-z]{1,20}", re.sub("<[^>]*>", " ", html or "").lower()))
    total = sum(words.values()) + 1

    def tokens(url):
        host, path = parse(url)
        own = [f"h:{w}" for label in re.split("[^a-z]+", host) if label
               for w in viterbi(label, words, total)]
        low = "".join(c.lower() if c.isascii() else c for c in path)
        return own + [f"p:{w}" for w in re.split("[^a-z#]+", re.sub("[0-9]+", " # ", low)) if w]
    good, bad = Counter(), Counter()
    for _, url, _ in pages:
        verdict = rule_of(*parse(url))[2]
        if verdict:
            (good if verdict == "allow" else bad).update(tokens(url))
    kinds = len(set(good) | set(bad))
    shift = math.log((sum(good.values()) + kinds + 1) / (sum(bad.values()) + kinds + 1))
    want = {}
    for page, url, _ in pages:
        known = [t for t in tokens(url) if t in good or t in bad]
        want[page] = sum(math.log((bad[t] + 1) / (good[t] + 1)) + shift for t in known)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = judge_urls(df).collect()
    assert len(rows) == len(pages)
    address = {page: url for page, url, _ in pages}
    for r in rows:
        assert r.score == pytest.approx(want[r.page_id], abs=1e-5)
        verdict = rule_of(*parse(address[r.page_id]))[2]
        assert r.verdict == (verdict or ("block" if round(want[r.page_id], 6) > 0 else "allow"))
