from __future__ import annotations

import json
import os
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripletspark.plans.stages import Stage, run_stages
from tripletspark.session import scratch_path, shared_folder
from tripletspark.sources import cache, files, sinks, synthetic


def put(base, name, data):
    path = os.path.join(base, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_scan_and_ingest(spark, tmp_path):
    root = str(tmp_path)
    folder = "p0-p1-p2-site-cpoolday05-alice-x"
    put(root, f"{folder}/ex1/a.c", b"/* head */\r\nint x;\r\n")
    put(root, f"{folder}/ex1/blank.c", b"/* only */ \n")
    put(root, "foo/b.c", "int é;".encode())
    put(root, "foo/bad.c", b"\xff\xfe\x00")
    put(root, "foo/skip.txt", b"no")
    found, skipped = files.scan_source_files(spark, root)
    assert {os.path.basename(r.path): r.content for r in found.collect()} == {
        "a.c": "/* head */\nint x;\n", "blank.c": "/* only */ \n", "b.c": "int é;"}
    assert [os.path.basename(r.path) for r in skipped.collect()] == ["bad.c"]
    rows = files.ingest(found, f"file:{root}").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.header, r.code_snippet, r.exercise) == ("head", "int x;", "a")
    assert (r.cohort, r.site) == ("cpoolday05", "site")
    again = files.ingest(files.scan_source_files(spark, root)[0], f"file:{root}").first()
    assert again.code_id == r.code_id
    with pytest.raises(FileNotFoundError):
        files.scan_source_files(spark, root, "*.zig")


def test_jsonl_modes(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1, "b": "x"}\n\n  \n{"a": 2}\n')
    good, _ = files.scan_jsonl(spark, path, "a int, b string", "skip_blank")
    assert [(r.a, r.b) for r in good.collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="malformed"):
        files.scan_jsonl(spark, path, "a int, b string", "strict")[0].collect()
    with pytest.raises(Exception, match="malformed"):
        files.scan_jsonl(spark, path, "a int, b string", "strict")[0].count()
    with open(path, "a") as f:
        f.write("{oops\n")
    with pytest.raises(Exception, match="malformed"):
        files.scan_jsonl(spark, path, "a int, b string", "skip_blank")[0].collect()
    good, bad = files.scan_jsonl(spark, path, "a int, b string", "skip_bad")
    assert good.count() == 2 and [r.value for r in bad.collect()] == ["{oops"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "id int, t string")
    path = str(tmp_path / "j")
    sinks.sink_jsonl(df, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert json.loads(lines[0]) == {"id": 1, "t": None} and "é" in lines[1]
    sinks.append_jsonl(df, path)
    assert spark.read.text(path).count() == 4
    sinks.sink_parquet(df, str(tmp_path / "p"))
    sinks.sink_parquet(df.limit(1), str(tmp_path / "p"))
    assert files.scan_parquet(spark, str(tmp_path / "p")).count() == 1
    sinks.parquet_to_jsonl(spark, str(tmp_path / "p"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 1
    put(str(tmp_path), "file", b"x")
    with pytest.raises(OSError):
        sinks.append_jsonl(df, str(tmp_path / "file" / "sub"))


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.log_run(spark, path, {"run_id": "a", "num_epochs": 3}, datetime(2024, 1, 2, 3, 4, 5))
    sinks.log_run(spark, path, {"run_id": "b"})
    log = sinks.read_run_log(spark, path)
    r = log.filter("run_id = 'a'").first()
    assert len(log.columns) == 22 and (r.timestamp, r.num_epochs, r.notes) == (
        "2024-01-02 03:04:05", "3", None)
    sinks.run_log_csv(log, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.filter("run_id = 'b'").first().num_epochs == "N/A"
    with pytest.raises(ValueError):
        sinks.log_run(spark, path, {"nope": 1})


def test_cache(spark, tmp_path):
    store = cache.EmbeddingCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, t string")
    seen: list[int] = []

    def encode(d):
        seen.append(d.count())
        return d.withColumn("embedding", F.array(F.length("t").cast("float"), F.lit(1.0)))

    assert store.get_or_encode(df, "t", "m", encode).count() == 3
    assert store.get_or_encode(df, "t", "m", encode).count() == 3
    assert seen == [2, 0]
    hit, miss = store.get(df.union(spark.createDataFrame([(4, "new")], df.schema)), "t", "m")
    assert hit.count() == 3 and [r.id for r in miss.collect()] == [4]
    assert store.get(df, "t", "other")[0].count() == 0
    store.get_or_encode(df, "t", "other", encode)
    store.clear("m")
    assert store.get(df, "t", "m")[0].count() == 0 and store.get(df, "t", "other")[0].count() == 3
    store.clear()
    assert store.get(df, "t", "other")[0].count() == 0


def test_cache_opens_only_the_buckets_it_needs(spark, tmp_path):
    store = cache.EmbeddingCache(spark, str(tmp_path / "cache"), buckets=256)
    df = spark.range(400).select("id", F.concat(F.lit("t"), "id").alias("t"))
    def coded(d):
        return d.withColumn("embedding", F.array(F.col("id").cast("float")))
    store.put(coded(df), "t", "m")
    store.put(coded(df.filter("id < 50")), "t", "m")
    kept = spark.read.parquet(str(tmp_path / "cache"))
    assert kept.count() == 400 and kept.select("bucket").distinct().count() > 150
    hit, miss = store.get(df.filter("id < 3").union(df.filter("id < 3")), "t", "m")
    assert sorted(r.id for r in hit.collect()) == [0, 0, 1, 1, 2, 2] and miss.count() == 0
    plan = hit._jdf.queryExecution().executedPlan().toString()
    asked = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in asked and "model#" in asked and asked.count(",") < 8
    assert {r.embedding[0] for r in hit.collect()} == {0.0, 1.0, 2.0}


def test_synthetic(spark):
    rows = synthetic.generate_triplets(spark, 25).collect()
    assert len({r.code_id for r in rows}) == 25
    assert len({r.code_snippet for r in rows}) == 10
    assert sorted(Counter(r.code_snippet for r in rows).values()) == [2] * 5 + [3] * 5
    assert all(r.conceptual_feedback != r.hard_negative_feedback for r in rows)
    again = {r.code_id for r in synthetic.generate_triplets(spark, 25).collect()}
    assert again == {r.code_id for r in rows}


def test_done_rows_of_an_output_file(spark, tmp_path):
    path = str(tmp_path / "out.jsonl")
    assert files.scan_done(spark, path, "code_id") is None
    with open(path, "w") as f:
        f.write('{"code_id": "a", "x": 1}\n\n{"x": 2}\n{bad\n{"code_id": "b"}\n')
    assert sorted(r.code_id for r in files.scan_done(spark, path, "code_id").collect()) == [
        "a", "b"]


def test_stages(spark, tmp_path):
    base = str(tmp_path)
    calls: list[str] = []

    def step(name, fn):
        def run(s, d):
            calls.append(name)
            return fn(s, d)
        return Stage(name, run, f"{base}/{name}")

    stages = [step("one", lambda s, d: s.range(5)), step("two", lambda s, d: d.filter("id > 2"))]
    assert run_stages(spark, stages, log_path=f"{base}/log") == {"one": "ok", "two": "ok"}
    assert run_stages(spark, stages) == {"one": "skipped", "two": "skipped"}
    assert run_stages(spark, stages, only="two", skip_existing=False) == {"two": "ok"}
    assert calls == ["one", "two", "two"] and spark.read.parquet(f"{base}/two").count() == 2

    def boom(s, d):
        raise RuntimeError("bad stage")
    with pytest.raises(RuntimeError):
        run_stages(spark, [*stages, Stage("three", boom, f"{base}/three")],
                   log_path=f"{base}/log")
    notes = [r.notes for r in sinks.read_run_log(spark, f"{base}/log").collect()]
    assert any("three: failed: bad stage" in n for n in notes)
    with pytest.raises(ValueError):
        run_stages(spark, stages, only="nine")


def test_shared_folder_comes_from_the_session(spark):
    first = shared_folder(spark)
    assert shared_folder(spark) == first
    assert scratch_path(spark, "x").startswith(first)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_shared_folder_of_a_cluster_is_used_as_it_is():
    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        conf = {"spark.checkpoint.dir": "s3a://shared/tmp"}
        sparkContext = Context()

    assert shared_folder(Session()) == "s3a://shared/tmp"
    assert Session.sparkContext.folder == "s3a://shared/tmp"
