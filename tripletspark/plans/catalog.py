"""Registered queries: every operator applied to the given tables.

Each query takes (spark, folder with the parquet tables) and returns a DataFrame; its SQL
twin of the same name is in ``oracle.py``. Round-trip queries write to the shared folder
that the session names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletspark.functions import text as tx
from tripletspark.functions import vectors as vx
from tripletspark.operators import approx, indexing, metrics, monitor, negatives, pairs, quality
from tripletspark.operators import retrieval, sampling, similarity, triplets
from tripletspark.operators import models
from tripletspark.plans.stages import Stage, run_stages
from tripletspark.session import cut_lineage, scratch_path
from tripletspark.sources import files, sinks, synthetic
from tripletspark.sources.cache import EmbeddingCache
from tripletspark.streaming.incremental import incremental_process, processed
from tripletspark.streaming.live import live_monitor, store_windows, stored_windows

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files_of(sf: str, name: str) -> str:
    """A pattern for one table, be it a file or a folder of part files: a stream takes both by a
    pattern, but no file by its name."""
    return f"{sf}/{name}.parque[t]"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Quantiles and means of six-decimal values can end exactly on half a millionth.
FINER = {"median": 8, "q25": 8, "q75": 8, "median_pos": 8, "median_neg": 8, "mean": 10}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, integers to long: the form results are compared in."""
    kinds = {"double": lambda c: F.round(c, FINER.get(c, 6)), "float": lambda c: r6(F.col(c).cast("double")),
             "int": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[k](c).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


def digest(c: Column | str) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


# ------------------------------------------------------------------- A sources and sinks

@query
def a1_scan_source_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "tree")
    (docs(spark, sf).select("lang", "text").write.partitionBy("lang")
     .option("maxRecordsPerFile", 10_000).text(root))
    found, _ = files.scan_source_files(spark, root, "*.txt")
    return (found.withColumn("lang", F.regexp_extract("path", "lang=([^/]+)", 1))
            .groupBy("lang")
            .agg(F.sum(F.length("content")).alias("n_chars"),
                 F.sum(F.size(F.split("content", "\n")) - 1).alias("n_lines")))


@query
def a2_scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    d = files.scan_parquet(spark, f"{sf}/documents.parquet",
                           "doc_id long, text string, lang string, n_chars long")
    return d.select("doc_id", digest("text").alias("text_md5"), "lang", "n_chars")


@query
def a3_scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    labels = table(spark, sf, "labels")
    lines = (docs(spark, sf).select(F.to_json(F.struct("doc_id", "text", "lang", "n_chars")).alias("value"))
             .unionByName(labels.filter("toxic = 1").select(
                 F.concat(F.lit('{"doc_id": '), F.col("doc_id")).alias("value")))
             .unionByName(labels.filter("quality = 0").select(F.lit("  ").alias("value"))))
    lines.write.text(path)
    good, bad = files.scan_jsonl(spark, path,
                                 "doc_id long, text string, lang string, n_chars long", "skip_bad")
    return good.select(F.lit("good").alias("side"), "doc_id", digest("text").alias("text_md5"),
                       "lang", "n_chars").unionByName(
        bad.select(F.lit("rejected").alias("side"),
                   F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("doc_id"),
                   F.lit(None).cast("string").alias("text_md5"),
                   F.lit(None).cast("string").alias("lang"),
                   F.lit(None).cast("long").alias("n_chars")))


@query
def a4_head(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.head(docs(spark, sf).select("doc_id", "lang", "n_chars"), 100, "doc_id")


@query
def a5_sink_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    sinks.sink_parquet(docs(spark, sf), path)
    return files.scan_parquet(spark, path).select("doc_id", digest("text").alias("text_md5"))


@query
def a6_sink_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    wide = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    sinks.sink_jsonl(wide.select("doc_id", "text", "quality"), path)
    good, _ = files.scan_jsonl(spark, path, "doc_id long, text string, quality long")
    return good.select("doc_id", digest("text").alias("text_md5"), "quality")


@query
def a7_append_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    d = docs(spark, sf).select("doc_id", "text", "lang", "n_chars")
    sinks.append_jsonl(d.filter("lang = 'en'"), path)
    sinks.append_jsonl(d.filter("lang <> 'en'"), path)
    good, _ = files.scan_jsonl(spark, path, "doc_id long, text string, lang string, n_chars long")
    return good.select("doc_id", digest("text").alias("text_md5"), "lang", "n_chars")


@query
def a8_convert(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    sinks.parquet_to_jsonl(spark, f"{sf}/labels.parquet", path)
    good, _ = files.scan_jsonl(spark, path, "doc_id long, quality long, toxic long")
    return good


@query
def a9_log_run(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    n = table(spark, sf, "labels").agg(F.sum("quality").alias("n")).first().n
    sinks.log_run(spark, path, {"run_id": "r1", "final_metric_value": n})
    sinks.log_run(spark, path, {"run_id": "r2", "notes": "empty"})
    return sinks.read_run_log(spark, path).select("run_id", "final_metric_value", "notes",
                                                  "llm_model")


@query
def a10_sink_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    long = (docs(spark, sf).groupBy("lang")
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
            .select(F.lit("documents").alias("metric"), F.col("lang").alias("k"), "value"))
    sinks.sink_metrics(long, path)
    parsed = spark.read.text(path).select(
        F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return parsed.select(F.explode(F.col("m")["documents"]).alias("k", "value"))


@query
def a11_embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    cache = EmbeddingCache(spark, scratch_path(spark, "cache"))
    d = vecs(spark, sf).withColumn("text", F.concat(F.lit("item "), "vec_id"))
    cache.put(d.filter("label < 5"), "text", "m1")
    cache.put(d, "text", "m2")
    hit, miss = cache.get(d.drop("embedding"), "text", "m1")
    return (hit.withColumn("cached", F.size("embedding").cast("long"))
            .select("vec_id", "cached")
            .unionByName(miss.select("vec_id", F.lit(0).cast("long").alias("cached"))))


def _measured(texts: DataFrame) -> DataFrame:
    """A model in columns: length, words and letters e of a text."""
    t = F.col("text")
    return texts.withColumn("embedding", F.array(
        F.length(t), F.size(F.split(t, " ")), F.length(t) - F.length(F.translate(t, "e", "")))
        .cast("array<float>"))


@query
def a11_get_or_encode(spark: SparkSession, sf: str) -> DataFrame:
    """All texts' vectors, first with half of them stored, then with all."""
    cache = EmbeddingCache(spark, scratch_path(spark, "cache"))
    d = docs(spark, sf).select("doc_id", "text")
    cache.put(_measured(d.filter("doc_id % 2 = 0")), "text", "lengths")
    cold = cache.get_or_encode(d, "text", "lengths", _measured)
    warm = cache.get_or_encode(d, "text", "lengths", _measured)
    both = cold.withColumn("run", F.lit("cold")).unionByName(warm.withColumn("run", F.lit("warm")))
    e = F.col("embedding")
    return rounded(both.select("run", "doc_id", e[0].alias("chars"), e[1].alias("words"),
                               e[2].alias("letters_e")))


@query
def a12_generate_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.triplets_for(docs(spark, sf), "doc_id")


# ------------------------------------------------------------------------ B text columns

@query
def b1_split_header(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    comment = F.concat(F.lit("\n/* "), "source", F.lit(" */\n"), "text")
    late = F.concat(F.lit("x /* "), "source", F.lit(" */\n"), "text")
    long = d.select("doc_id", F.explode(F.array(
        F.struct(F.lit("start").alias("variant"), comment.alias("c")),
        F.struct(F.lit("later").alias("variant"), late.alias("c")))).alias("x")
    ).select("doc_id", "x.*")
    header, body = tx.split_header("c")
    return long.select("doc_id", "variant", header.alias("header"),
                       digest(body).alias("body_md5"))


@query
def b1_split_html_header(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn(
        "c", F.concat(F.lit("<!-- "), "url", F.lit(" -->"), "html"))
    header, body = tx.split_header("c", tx.HTML_HEADER)
    plain, _ = tx.split_header("html", tx.HTML_HEADER)
    return p.select("page_id", header.alias("header"), digest(body).alias("body_md5"),
                    plain.alias("plain_header"))


def _page_paths(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)", 1)
    lang = F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1)
    folder = F.when(host.contains("spam"), host).otherwise(
        F.concat(F.lit("b-i-o-"), lang, F.lit("-x-cpoolday"), F.col("page_id"), F.lit("-"), host))
    return table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/src/tree/"), folder, F.lit("/ex/main.c")).alias("path"))


@query
def b2_parse_path(spark: SparkSession, sf: str) -> DataFrame:
    return (_page_paths(spark, sf).withColumn("p", tx.parse_path("path", "/src/tree"))
            .select("page_id", "p.*"))


@query
def b3_pseudonymize(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return docs(spark, sf).select("doc_id", tx.pseudonymize(name).alias("uid"))


@query
def b4_assign_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.assign_id("url", "html").alias("uid"))


@query
def b5_clean_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    clean = tx.clean_whitespace("text")
    return docs(spark, sf).select("doc_id", clean.alias("c")).select(
        "doc_id", digest("c").alias("text_md5"), F.length("c").cast("long").alias("n_chars"))


@query
def b6_truncate_chars(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(
        "doc_id", digest(tx.truncate_chars("text", 2000)).alias("cut_md5"),
        tx.truncate_chars("text", 100, "...").alias("preview"))


@query
def b7_instruction_prefix(spark: SparkSession, sf: str) -> DataFrame:
    names = ["BGE-base", "multilingual-e5", "embeddinggemma", "MiniLM"]
    role = F.when(F.col("role") == "user", "query").when(F.col("role") == "assistant", "passage")
    c = table(spark, sf, "conversations").withColumn(
        "model", F.explode(F.array(*[F.lit(n) for n in names])))
    return c.select("conv_id", "turn", "model", digest(tx.instruction_prefix(
        "text", "model", F.coalesce(role, F.lit("none")))).alias("text_md5"))


@query
def b8_resolve_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source").alias("code_snippet"),
        F.when(F.col("quality") == 1, F.col("text")).alias("conceptual_feedback"),
        F.when(F.col("quality") == 0, F.upper("lang")).alias("refined_feedback"),
        F.when(F.col("toxic") == 1, F.array("lang", "source")).alias("negative_feedbacks"),
        F.when(F.col("quality") == 1, F.col("lang")).alias("hard_negative_feedback"))
    good, _ = triplets.resolve_fields(d, "doc_id")
    return good.select("id", "anchor", digest("positive").alias("positive_md5"),
                       F.array_join("negatives", "|").alias("negatives"))


@query
def b9_render_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    two = tx.system_and_user("Answer as {role}.", "text")
    one = tx.single_user("CODE {code} GOOD {positive}", {"code": "text", "positive": "role"})

    def flat(m: Column) -> Column:
        return F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])),
                            "|")
    return c.select("conv_id", "turn", digest(flat(two)).alias("two_md5"),
                    digest(flat(one)).alias("one_md5"))


@query
def b10_similarity_band(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    hits = similarity.mips_topk(v, v, 5, query_id="vec_id", doc_id="vec_id")
    return (hits.select("query_id", "doc_id", r6("score").alias("s"))
            .select("query_id", "doc_id", "s", tx.similarity_band("s").alias("band"),
                    tx.result_badge("s").alias("badge"), tx.quality_grade("s").alias("grade")))


@query
def b11_parse_judgement(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"quality_score": '), F.col("quality") * 90, F.lit(
        ', "is_factually_correct": '), (F.col("quality") == 1).cast("string"),
        F.lit(', "issues": ["i"], "needs_correction": false}'))
    answer = (F.when(F.col("toxic") == 1, F.concat(F.lit("no json "), "doc_id"))
              .when(F.col("quality") == 1, F.concat(F.lit("Here:\n```json\n"), body,
                                                   F.lit("\n```\nDone")))
              .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```"))))
    v = tx.parse_judgement("a")
    return (table(spark, sf, "labels").select("doc_id", answer.alias("a")).withColumn("v", v)
            .select("doc_id", F.col("v.quality_score").alias("score"),
                    F.col("v.is_factually_correct").alias("correct"),
                    F.array_join("v.issues", "|").alias("issues"),
                    F.col("v.needs_correction").alias("needs_correction")))


@query
def b12_drop_legacy(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "lang", F.col("source").alias("random_negative"),
                               F.col("text").alias("hard_negative_feedback"))
    return quality.drop_legacy(d)


@query
def b13_item_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("negatives", F.split("text", "\n"))
    return rounded(metrics.item_stats(d, "source", "text", "negatives")
                   .select("doc_id", "code_chars", "feedback_chars", "n_negatives"))


@query
def b14_extract_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", tx.extract_json("props", "$.k").cast("long").alias("k"))


# --------------------------------------------------------------- C filters and validation

def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")


@query
def c1_require_fields(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = quality.require_fields(_labelled(spark, sf), ["text", "quality", "toxic"])
    return (good.select("doc_id", F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select("doc_id", "reason")))


@query
def c2_filter_length(spark: SparkSession, sf: str) -> DataFrame:
    return quality.filter_length(docs(spark, sf), "text", 10, 5000).select("doc_id", "n_chars")


@query
def c3_drop_blank(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf).withColumn(
        "note", F.when(F.col("toxic") == 1, "   \n").when(F.col("quality") == 1, " ok "))
    return quality.drop_blank(d, ["text", "note"]).select("doc_id", "note")


@query
def c4_reject_unparsed(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reject_unparsed(b2_parse_path(spark, sf), ["author", "cohort", "site"])


@query
def c5_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return quality.remaining(docs(spark, sf), table(spark, sf, "labels"), "doc_id") \
        .select("doc_id", "lang")


@query
def c6_dataset_checks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dataset_checks(_labelled(spark, sf), "text", ["text", "quality"], 50, 10000)


@query
def c6_length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Length quantiles by language from sketches of two loads, stored and merged, and whether
    their exact rank is within the stated bound."""
    path, d = scratch_path(spark, "sketches"), docs(spark, sf)
    for load in (d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 <> 0")):
        quality.length_sketches(load, "text", ["lang", "source"]).write.mode("append").parquet(path)
    got = quality.length_quantiles(spark.read.parquet(path), group_cols=["lang"])
    ranks = (d.select("lang", F.length("text").alias("size")).join(F.broadcast(got), "lang")
             .groupBy("lang", "share", "n", "n_chars")
             .agg(F.count_if(F.col("size") < F.col("n_chars")).alias("below"),
                  F.count_if(F.col("size") <= F.col("n_chars")).alias("upto")))
    slack = quality.SKETCH_ERROR * F.col("n") + 1
    return ranks.select("lang", "share", "n", (
        (F.col("below") <= F.col("share") * F.col("n") + slack)
        & (F.col("upto") >= F.col("share") * F.col("n") - slack)).alias("within_bound"))


# ------------------------------------------------------------ D deduplication and merging

@query
def d1_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dedup(docs(spark, sf), "text", "first", "doc_id").select("doc_id", "lang")


@query
def d1_dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dedup(docs(spark, sf), "text", "last", "doc_id").select("doc_id", "lang")


@query
def d1_dedup_none(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dedup(docs(spark, sf), "text", False, "doc_id").select("doc_id", "lang")


@query
def d2_merge_collections(spark: SparkSession, sf: str) -> DataFrame:
    d, done = docs(spark, sf), table(spark, sf, "labels").select("doc_id")
    old = d.join(done, "doc_id", "left_semi").select("doc_id", "text", "lang")
    new = d.join(done, "doc_id", "left_anti").select("doc_id", "text", "source")
    return quality.merge_collections(old, new, "text", "doc_id").select(
        "doc_id", "lang", "source")


@query
def d3_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return quality.preprocess(docs(spark, sf), "text", "doc_id").select(
        "doc_id", digest("text").alias("text_md5"))


@query
def d3_preprocess_report(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return quality.preprocess_report(d, quality.preprocess(d, "text", "doc_id"))


# --------------------------------------------------------------------------- E sampling

@query
def e1_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_n(docs(spark, sf), 100, "doc_id").select("doc_id", "lang")


@query
def e2_train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    train, val = sampling.train_val_split(docs(spark, sf).select("doc_id"), "doc_id", 0.1)
    return (train.withColumn("part", F.lit("train"))
            .unionByName(val.withColumn("part", F.lit("validation"))))


@query
def e3_random_partners(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampling.random_partners(docs(spark, sf), "doc_id", 5))


@query
def e3_random_negatives(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "text")
    return sampling.random_negatives(d, "doc_id", "text", 3).select(
        "doc_id", digest(F.array_join("negatives", "|")).alias("negatives_md5"))


@query
def e4_balanced_negative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    return pairs.balanced_negative_pairs(v, ["label"], "vec_id", v.count())


# ------------------------------------------------------------- F vectors and similarity

@query
def f1_embed_callable(spark: SparkSession, sf: str) -> DataFrame:
    def make_encoder():
        return lambda texts: [[len(t), t.count(" "), t.count("\n")] for t in texts]
    d = models.embed(docs(spark, sf).select("doc_id", "text"), "text", make_encoder)
    return d.select("doc_id", *[F.element_at("embedding", i + 1).cast("long").alias(n)
                                for i, n in enumerate(("n_chars", "n_spaces", "n_lines"))])


@query
def f1_embed_default(spark: SparkSession, sf: str) -> DataFrame:
    d = models.embed_default(docs(spark, sf).select("doc_id", "text"), "text", dims=128)
    cells = d.select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
    return rounded(cells)


@query
def f2_sanitize_vectors(spark: SparkSession, sf: str) -> DataFrame:
    bad = (F.when(F.col("label") == 0, float("nan")).when(F.col("label") == 1, float("inf"))
           .when(F.col("label") == 2, float("-inf")))
    d = vecs(spark, sf).withColumn("v", F.concat(
        F.array(F.coalesce(bad, F.lit(0.5))), F.col("embedding").cast("array<double>")))
    clean = vx.sanitize_vectors("v")
    return d.select("vec_id", vx.has_bad_numbers("v").alias("repaired"),
                    r6(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query
def f3_l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label"))
    d = vecs(spark, sf).select("vec_id", vx.l2_normalize(scaled).alias("u"))
    return d.select("vec_id", r6(vx.norm("u")).alias("norm"),
                    r6(F.element_at("u", 1)).alias("first"))


def _vector_pairs(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """(vec_id, pos, neg_id, va, vb): each vector with k random others."""
    v = vecs(spark, sf)
    drawn = sampling.random_partners(v, "vec_id", k)
    a = v.select("vec_id", F.col("embedding").alias("va"))
    b = v.select(F.col("vec_id").alias("neg_id"), F.col("embedding").alias("vb"))
    return drawn.join(a, "vec_id").join(b, "neg_id")


@query
def f4_cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_pairs(spark, sf).select(
        "vec_id", "neg_id", r6(vx.cosine_similarity("va", "vb")).alias("cos"))


@query
def f5_cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.transform(F.col("va").cast("array<double>"), lambda x: x * 0.0)
    return _vector_pairs(spark, sf).select(
        "vec_id", "neg_id", r6(vx.cosine_distance("va", "vb")).alias("dist"),
        r6(vx.cosine_distance(zero, "vb")).alias("failed_dist"))


@query
def f6_lp_distances(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_pairs(spark, sf).select(
        "vec_id", "neg_id", r6(vx.euclidean_distance("va", "vb")).alias("l2"),
        r6(vx.manhattan_distance("va", "vb")).alias("l1"))


@query
def f7_mips_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    return rounded(similarity.mips_topk(v, v, 10, query_id="vec_id", doc_id="vec_id",
                                        exclude_self=True))


@query
def f7_mips_topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    return rounded(similarity.mips_topk(v, v, 10, query_id="vec_id", doc_id="vec_id",
                                        exclude_self=True, broadcast_rows=0))


@query
def f8_self_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similarity.self_similarity(vecs(spark, sf), id_col="vec_id"))


@query
def f8_self_similarity_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similarity.self_similarity_moments(vecs(spark, sf)))


@query
def f9_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    d = vecs(spark, sf).withColumn("w", F.abs(F.element_at("embedding", 1).cast("double")))
    pooled = models.mean_pool(d, ["label"], weight="w")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("pos", "value")))


@query
def f10_project(spark: SparkSession, sf: str) -> DataFrame:
    coords, _ = models.project(vecs(spark, sf), 2)
    return rounded(coords.select("vec_id", F.col("coords")[0].alias("x"),
                                 F.col("coords")[1].alias("y")))


# --------------------------------------------------------------- G negatives and triplets

BAND = {"lo": 0.3, "hi": 0.5}


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(vecs(spark, sf), 2, id_col="vec_id", **BAND)


def _every_fiftieth(spark: SparkSession, sf: str) -> tuple[DataFrame, approx.CellIndex]:
    v = vecs(spark, sf)
    index = approx.build_index(v, scratch_path(spark, "cells"), id_col="vec_id")
    return v.filter("vec_id % 50 = 0"), index


@query
def f11_approx_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every fiftieth row from the fitted number of cells."""
    q, index = _every_fiftieth(spark, sf)
    return rounded(approx.approx_topk(q, index, 10, query_id="vec_id", exclude_self=True))


@query
def f11_index_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same index asked for exact results, by the path for many queries."""
    q, index = _every_fiftieth(spark, sf)
    return rounded(approx.approx_topk(q, index, 10, query_id="vec_id", exclude_self=True,
                                      exact=True, broadcast_rows=0))


@query
def f11_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What the approximate search finds of the exact one's results."""
    q, index = _every_fiftieth(spark, sf)
    exact = similarity.mips_topk(q, vecs(spark, sf), 10, query_id="vec_id", doc_id="vec_id",
                                 exclude_self=True)
    return rounded(approx.recall_at_k(
        approx.approx_topk(q, index, 10, query_id="vec_id", exclude_self=True), exact))


@query
def g1_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_mined(spark, sf))


@query
def g2_hybrid_negatives(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf).withColumn("text", F.col("vec_id").cast("string"))
    out = negatives.hybrid_negatives(v, "text", 5, 2, id_col="vec_id", **BAND)
    return rounded(out.select("vec_id", F.array_join("negative_feedbacks", "|").alias("negatives"),
                              "negatives_metadata.*"))


@query
def g3_ranked_negatives(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    hits = cut_lineage(similarity.mips_topk(v, v, 20, query_id="vec_id", doc_id="vec_id",
                                            exclude_self=True))
    return rounded(metrics.union_all([
        similarity.pick_ranked(hits, 3, s, id_col="vec_id").withColumn("strategy", F.lit(s))
        for s in similarity.STRATEGIES]))


@query
def g4_mining_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(negatives.mining_report(_mined(spark, sf), vecs(spark, sf), 2))


@query
def g5_explode_triplets(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "text", "source")
    listed = sampling.random_negatives(d, "doc_id", "text", 3)
    return rounded(triplets.explode_triplets(listed, "doc_id", "source", "text", "negatives")
                   .select("doc_id", "n_negatives", "neg_pos", "anchor",
                           digest("positive").alias("positive_md5"),
                           digest("negative").alias("negative_md5")))


def _drawn_items(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "text", "source")
    return sampling.random_negatives(d, "doc_id", "text", 2)


@query
def g6_triplet_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = triplets.triplet_graph(_drawn_items(spark, sf), 30, id_col="doc_id",
                                      anchor="text", positive="source")
    return rounded(nodes.select("doc_id", "item", "node_id", "type", "label",
                                digest("text").alias("text_md5")))


@query
def g6_triplet_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = triplets.triplet_graph(_drawn_items(spark, sf), 30, id_col="doc_id",
                                      anchor="text", positive="source")
    return edges


@query
def g6_item_graph(spark: SparkSession, sf: str) -> DataFrame:
    return triplets.item_graph(_drawn_items(spark, sf), id_col="doc_id", anchor="text",
                               positive="source").select(
        "doc_id", "type", "label", digest("text").alias("text_md5"))


@query
def g7_apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    edits = labels.select("doc_id", F.lit(1).alias("at"), F.lit("first").alias("source"),
                          F.lit("xx").alias("lang")).unionByName(
        labels.filter("quality = 1").select(
            "doc_id", F.lit(2).alias("at"), F.concat(F.lit("t"), "toxic").alias("source"),
            F.lit(None).cast("string").alias("lang")))
    base = docs(spark, sf).select("doc_id", "source", "lang")
    return triplets.apply_edits(base, edits, "doc_id", ["source", "lang"], "at")


# ------------------------------------------------------------------------------ H metrics

def vector_triplets(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """(id, label, neg_pos, anchor, positive, negative): the positive is the next member of
    the label's hash order, the negatives are k random vectors."""
    v = vecs(spark, sf)
    members = indexing.dense_index(v.select("vec_id", "label"), "vec_id", group_cols=["label"],
                                   out="m")
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    nxt = members.join(sizes, "label").select(
        F.col("vec_id").alias("id"), "label", ((F.col("m") + 1) % F.col("size")).alias("m"))
    positives = nxt.join(members.select("label", "m", F.col("vec_id").alias("pos_id")),
                         ["label", "m"]).select("id", "label", "pos_id")
    drawn = sampling.random_partners(v, "vec_id", k).select(
        F.col("vec_id").alias("id"), F.col("pos").alias("neg_pos"), "neg_id")

    def side(key: str, name: str) -> DataFrame:
        return v.select(F.col("vec_id").alias(key), F.col("embedding").alias(name))

    return (drawn.join(positives, "id").join(side("id", "anchor"), "id")
            .join(side("pos_id", "positive"), "pos_id")
            .join(side("neg_id", "negative"), "neg_id")
            .select("id", "label", "neg_pos", "anchor", "positive", "negative"))


@query
def h1_triplet_loss(spark: SparkSession, sf: str) -> DataFrame:
    t = vector_triplets(spark, sf)
    d = triplets.triplet_distances(t, "euclidean")
    batched = indexing.assign_batches(vecs(spark, sf).select(F.col("vec_id").alias("id")), 32,
                                      "id")
    return rounded(triplets.triplet_loss(d.join(batched, "id"), 0.5, "batch"))


@query
def h2_triplet_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = vector_triplets(spark, sf)
    return rounded(metrics.union_all([
        triplets.triplet_metrics(triplets.triplet_distances(t, name, unit=False), 0.5)
        .withColumn("distance", F.lit(name)) for name in ("cosine", "euclidean")]))


@query
def h3_validation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = triplets.triplet_distances(vector_triplets(spark, sf), "euclidean")
    return rounded(triplets.validation_metrics(d, 0.5))


@query
def h4_triplet_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    t = vector_triplets(spark, sf)
    return rounded(metrics.union_all([
        triplets.triplet_accuracy(triplets.triplet_distances(t, name, unit=False))
        .withColumn("distance", F.lit(name)) for name in ("cosine", "euclidean", "manhattan")]))


@query
def h5_separation_report(spark: SparkSession, sf: str) -> DataFrame:
    d = triplets.triplet_distances(vector_triplets(spark, sf), "cosine",
                                   keep=("id", "neg_pos", "label"))
    d = d.withColumn("model", F.concat(F.lit("m"), "label")).drop("label")
    return rounded(triplets.separation_report(d))


@query
def h6_similarity_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = _vector_pairs(spark, sf).select(vx.cosine_similarity("va", "vb").alias("s"))
    return rounded(metrics.similarity_stats(s, "s", above=0.1))


@query
def h7_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.histogram(docs(spark, sf), "n_chars", 40))


@query
def h8_dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("negatives", F.split("text", "\n"))
    return rounded(metrics.dataset_stats(d, "text", "negatives"))


@query
def h9_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.corpus_stats(docs(spark, sf), "text", vecs(spark, sf), "embedding"))


def _verdict(score: Column, correct: Column, fix: Column) -> Column:
    return F.struct(
        score.cast("double").alias("quality_score"), correct.alias("is_factually_correct"),
        correct.alias("is_conceptually_clear"), F.lit(None).cast("boolean").alias("is_applicable"),
        fix.alias("needs_correction"))


@query
def h10_judgement_summary(spark: SparkSession, sf: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    d = _labelled(spark, sf)
    refined = F.when(F.col("quality").isNotNull(), _verdict(F.col("quality") * 80, good, toxic))
    conceptual = F.when(toxic, _verdict(F.lit(None), ~good, good))
    return rounded(metrics.judgement_summary(
        d, {"refined_feedback": refined, "conceptual_feedback": conceptual}))


def _pair_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of one label, and as many drawn pairs of two labels, as a histogram."""
    return pairs.labelled_distances(vecs(spark, sf), ["label"], "vec_id", "embedding")


@query
def h11_threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.threshold_metrics(_pair_distances(spark, sf), "distance",
                                             "true_label", (0.5, 0.7, 0.8, 1.0), weight="n"))


@query
def h11_threshold_metrics_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the labelled pairs themselves, an even draw of as many as there are rows."""
    v = vecs(spark, sf)
    labelled = pairs.labelled_pairs(v, ["label"], "vec_id", v.count())
    drawn = pairs.pair_distances(labelled, v, "vec_id", "embedding")
    return rounded(metrics.threshold_metrics(drawn, "distance", "true_label",
                                             (0.5, 0.7, 0.8, 1.0)))


@query
def h12_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(_pair_distances(spark, sf), "distance", "true_label",
                                   weight="n"))


def _label_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = triplets.triplet_distances(vector_triplets(spark, sf), "cosine",
                                   keep=("id", "neg_pos", "label"))
    return s.groupBy(F.concat(F.lit("m"), "label").alias("model")).agg(
        F.avg(1.0 - F.col("neg_dist")).alias("mean_sim"))


@query
def h13_rank_models(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.rank_models(_label_scores(spark, sf), "mean_sim"))


@query
def h13_model_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.model_spread(_label_scores(spark, sf), "mean_sim"))


def _per_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for the others of its label; one top-100 table serves all."""
    v = vecs(spark, sf)
    hits = similarity.mips_topk(v, v, 100, query_id="vec_id", doc_id="vec_id",
                                exclude_self=True)
    marked = retrieval.mark_hits_by_group(hits, v, "vec_id", "label")
    return retrieval.per_query(marked, retrieval.relevance_totals_by_group(v, "vec_id", "label"))


@query
def h14_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.recall_at_k(_per_query(spark, sf)))


@query
def h15_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.mrr(_per_query(spark, sf)))


@query
def h16_ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.ndcg_at_k(_per_query(spark, sf)))


@query
def h17_map_at(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.map_at(_per_query(spark, sf)))


@query
def h18_retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.retrieval_report(_per_query(spark, sf), vecs(spark, sf)))


@query
def h19_precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.precision_at_k(_per_query(spark, sf)))


@query
def h20_item_similarity(spark: SparkSession, sf: str) -> DataFrame:
    out = triplets.item_similarity(vector_triplets(spark, sf))
    return rounded(out.withColumn("band", tx.similarity_band(r6("mean_sim"))))


# ------------------------------------------------------------------------------ I windows

@query
def i1_rank_within(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").cast("double").alias("price"))
    return rounded(retrieval.rank_within(line, "l_suppkey", "price", 3,
                                         ["l_orderkey", "l_linenumber"]))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Step metrics of runs: users are runs, events are steps."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "ts",
        F.col("value").alias("loss"), (F.col("value") / 10).alias("separation"),
        tx.extract_json("props", "$.k").cast("double").alias("violations_pct"))


def _seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query
def i2_rolling_window(spark: SparkSession, sf: str) -> DataFrame:
    out = monitor.rolling_window(_steps(spark, sf), "run_id", "ts", "loss", 10, ["event_id"])
    return rounded(out.select("event_id", "step_no", "rolling_mean", "rolling_min",
                              "rolling_max"))


@query
def i3_training_summary(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return rounded(monitor.training_summary(_steps(spark, sf), "run_id", order, _seconds()))


@query
def i4_step_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = monitor.step_rate(_steps(spark, sf), "run_id", _seconds(), "ts", ["event_id"])
    return rounded(out.select("event_id", F.round("steps_per_sec", 4).alias("steps_per_sec")))


@query
def i5_early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(monitor.early_stopping(_steps(spark, sf), "run_id", "ts", "loss", 5,
                                          ["event_id"]))


@query
def i6_assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.assign_batches(docs(spark, sf).select("doc_id"), 8, "doc_id")


@query
def i6_assign_batches_text(spark: SparkSession, sf: str) -> DataFrame:
    """Batches in the order of a text column that repeats, ties by doc_id."""
    return indexing.assign_batches(docs(spark, sf).select("doc_id", "lang"), 50, "lang",
                                   chunks=16, tie_cols=["doc_id"])


@query
def i6_global_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of every document by its whole text."""
    return indexing.global_rank(docs(spark, sf).select("doc_id", "text"), ["text", "doc_id"],
                                chunks=16).select("doc_id", "rank")


# --------------------------------------------------------------- J pairs and query sets

@query
def j1_pair_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.pair_groups(vecs(spark, sf), ["label"]))


@query
def j1_positive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    return rounded(pairs.positive_pairs(v, ["label"], "vec_id", v.count()))


@query
def j2_labelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    return rounded(pairs.labelled_pairs(v, ["label"], "vec_id", v.count()))


@query
def j3_make_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = retrieval.make_queries(docs(spark, sf), 100, id_col="doc_id", code="source",
                               feedback="text")
    return q.select("query", F.array_join("relevant_ids", "|").alias("relevant_ids"),
                    "metadata.code_id", "metadata.expected_feedback")


@query
def j4_qrels_join(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    hits = similarity.mips_topk(v, v, 10, query_id="vec_id", doc_id="vec_id",
                                exclude_self=True)
    drawn = sampling.random_partners(v, "vec_id", 20)
    qrels = drawn.select(F.col("vec_id").alias("query_id"), F.col("neg_id").alias("doc_id"),
                         (F.col("pos") + 1).alias("rel"))
    return rounded(retrieval.mark_hits(hits, qrels).select("query_id", "rank", "doc_id", "rel"))


@query
def j4_graded_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    hits = similarity.mips_topk(v, v, 10, query_id="vec_id", doc_id="vec_id",
                                exclude_self=True)
    drawn = sampling.random_partners(v, "vec_id", 20)
    qrels = drawn.select(F.col("vec_id").alias("query_id"), F.col("neg_id").alias("doc_id"),
                         (F.col("pos") + 1).alias("rel"))
    asked = v.select(F.col("vec_id").alias("query_id"))
    per = retrieval.per_query(retrieval.mark_hits(hits, qrels),
                              retrieval.relevance_totals(asked, qrels, (5, 10)), (5, 10))
    return rounded(per.select("query_id", "n_relevant", "first_rank", "ndcg_5", "ndcg_10", "ap"))


@query
def j5_similarity_range(spark: SparkSession, sf: str) -> DataFrame:
    out = similarity.similarity_range_counts(vecs(spark, sf), 0.3, 0.5, id_col="vec_id")
    total = F.coalesce(F.col("mean_sim") * F.col("n_in_range"), F.lit(0.0))
    return rounded(out.select("vec_id", "n_in_range", total.alias("total_sim"), "min_sim",
                              "max_sim"))


# ------------------------------------------------------------- K streams, L batch models

@query
def k1_incremental_process(spark: SparkSession, sf: str) -> DataFrame:
    out, point = scratch_path(spark, "incremental"), scratch_path(spark, "progress")
    schema = docs(spark, sf).schema

    def measure(batch: DataFrame) -> DataFrame:
        return batch.select("doc_id", F.length("text").cast("long").alias("n"))

    for _ in range(2):  # the second run finds nothing to do
        incremental_process(spark, files_of(sf, "documents"), out, point, "doc_id", measure,
                            schema)
    return processed(spark, out)


@query
def k1_retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one language each; those of one fail in the first run, the second takes them up
    from the dead letters and finds the progress of all others lost. The files are written where
    the rows are read, so no task holds a language; a batch takes one file of each such task."""
    source, out = scratch_path(spark, "by-language"), scratch_path(spark, "incremental")
    d = docs(spark, sf).select("doc_id", "text", "lang")
    down = F.col("lang").eqNullSafe("de")
    for rows in (d.filter(~down), d.filter(down)):  # the failing files come last
        (rows.withColumn("part", F.col("lang")).write.mode("append").partitionBy("part")
         .parquet(source))

    def measure(batch: DataFrame) -> DataFrame:
        return batch.select("doc_id", F.length("text").cast("long").alias("n"))

    def moody(batch: DataFrame) -> DataFrame:
        return measure(batch.filter(F.when(F.col("lang") == "de", F.raise_error(F.lit("down"))
                                           .cast("boolean")).otherwise(F.lit(True))))

    options = {"skip_failed": True, "files_per_batch": d.rdd.getNumPartitions()}
    incremental_process(spark, source, out, scratch_path(spark, "progress"), "doc_id", moody,
                        d.schema, **options)
    incremental_process(spark, source, out, scratch_path(spark, "progress"), "doc_id", measure,
                        d.schema, **options)
    return processed(spark, out)


@query
def k2_live_monitor(spark: SparkSession, sf: str) -> DataFrame:
    out, point = scratch_path(spark, "live"), scratch_path(spark, "progress")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(files_of(sf, "events"))
    store_windows(live_monitor(stream, "ts", "value", width="1 day", lateness="1 hour"), out,
                  point)
    done = stored_windows(spark, out)
    return rounded(done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "mean",
                               "min", "max"))


def _marking_model():
    return lambda batch: [messages[-1]["content"] + "!" for messages in batch]


@query
def l1_apply_chain(spark: SparkSession, sf: str) -> DataFrame:
    steps = [
        models.Step("Explain.", "text", "draft"),
        models.Step("{code}>{good}", "draft", "refined", {"code": "role", "good": "draft"},
                    runs=2),
    ]
    c = table(spark, sf, "conversations")
    return models.apply_chain(c, steps, _marking_model).select(
        "conv_id", "turn", digest("draft").alias("draft_md5"),
        digest("refined").alias("refined_md5"), "status")


def _judge_model():
    def answer(messages):
        text = messages[-1]["content"]
        if "Feedback:\nbad" in text:
            raise RuntimeError("refused")
        if "Feedback:\nodd" in text:
            return "no verdict"
        return '```json\n{"quality_score": 80, "is_factually_correct": true}\n```'
    return lambda batch: [answer(m) for m in batch]


@query
def l2_judge(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf).select("doc_id", "source", (
        F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 0, "odd")
        .when(F.col("quality") == 1, F.col("lang"))).alias("refined"))
    out = models.judge(d, ["refined"], _judge_model, code_col="source")
    v = F.col("refined_validation")
    return out.select("doc_id", v["quality_score"].alias("score"),
                      v["is_factually_correct"].alias("correct"),
                      F.array_join(v["issues"], "|").alias("issues"),
                      v["needs_correction"].alias("needs_correction"))


def _moody_model():
    def run(batch):
        if any(m[-1]["content"] == "assistant" for m in batch):
            raise RuntimeError("down")
        return ["ok"] * len(batch)
    return run


@query
def l3_failure_policy(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    results = models.apply_chain(c, [models.Step("x", "role", "answer")], _moody_model, batch=1)
    key = F.concat_ws("/", "conv_id", "turn")
    done = models.done_rows(results.withColumn("key", key), "key")
    todo = quality.remaining(c.withColumn("key", key), done, "key")
    return todo.select("conv_id", "turn", "role")


@query
def l4_run_stages(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "stages")
    stages = [
        Stage("collect", lambda s, _: docs(s, sf), f"{base}/collect"),
        Stage("clean", lambda s, d: quality.preprocess(d, "text", "doc_id"), f"{base}/clean"),
        Stage("split", lambda s, d: sampling.train_val_split(
            d.select("doc_id"), "doc_id")[1], f"{base}/split"),
    ]
    run_stages(spark, stages, log_path=f"{base}/log")
    run_stages(spark, stages, log_path=f"{base}/log")  # all outputs exist: nothing runs
    return spark.read.parquet(f"{base}/split")
