from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripletspark.streaming import incremental
from tripletspark.streaming.incremental import incremental_process, processed, retry_open
from tripletspark.streaming.live import live_monitor


def test_incremental_resumes(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    schema = "id long, t string"
    from pyspark.sql.types import StructType
    st = StructType.fromDDL(schema)

    def add(ids):
        spark.createDataFrame([(i, f"t{i}") for i in ids], schema).write.mode("append").parquet(src)

    def work(batch):
        return batch.withColumn("n", F.length("t"))

    def run(point):
        incremental_process(spark, src, out, point, "id", work, st, files_per_batch=1)

    add([1, 2])
    run(point)
    run(point)
    add([2, 3])                      # 2 is there already
    run(point)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    run(str(tmp_path / "lost"))      # the progress is lost: all files come again
    assert spark.read.parquet(out).count() == 3


def test_failed_batch_is_retried(spark, tmp_path):
    out = str(tmp_path / "out")
    source = spark.range(6)
    retry_open(spark, source, out, "id", lambda d: d.filter("id < 4"))
    retry_open(spark, source, out, "id", lambda d: d)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(6))


def test_batch_error_stops_and_resumes(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    spark.range(3).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def boom(batch):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="down"):
        incremental_process(spark, src, out, point, "id", boom, schema)
    incremental_process(spark, src, out, point, "id", lambda d: d, schema)
    assert spark.read.parquet(out).count() == 3


def test_failed_batch_can_be_skipped(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    for i in range(3):
        spark.range(i * 2, i * 2 + 2).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema

    def moody(batch):
        if batch.filter("id = 2").count():
            raise RuntimeError("down")
        return batch

    errors = incremental_process(spark, src, out, point, "id", moody, schema, files_per_batch=1,
                                 skip_failed=True)
    assert len(errors) == 1 and "down" in errors[0]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 4, 5]
    retry_open(spark, spark.read.parquet(src), out, "id", lambda d: d)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(6))


def test_dead_letters_are_drained(spark, tmp_path):
    """Batch 2 of 3 fails twice, then goes through: nothing is missing or doubled, and a batch
    never reads the output."""
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    for i in range(3):
        spark.range(i * 2, i * 2 + 3).coalesce(1).write.mode("append").parquet(src)  # overlaps
    schema = spark.read.parquet(src).schema
    read = []

    def moody(down):
        def fn(batch):
            read.append(batch._jdf.queryExecution().optimizedPlan().toString())
            rows = batch.filter("id >= 0")
            if down and rows.filter("id = 3").count():
                raise RuntimeError("down")
            return rows
        return fn

    def run(fn, at=point):
        return incremental_process(spark, src, out, at, "id", fn, schema, files_per_batch=1,
                                   skip_failed=True)
    first = run(moody(True))
    assert len(first) in (1, 2) and all("down" in e for e in first)
    assert run(moody(True)) and 3 not in {r.id for r in processed(spark, out).collect()}
    assert run(moody(False)) == []
    assert sorted(r.id for r in processed(spark, out).collect()) == list(range(7))
    assert run(moody(False)) == [] and run(moody(False), str(tmp_path / "lost")) == []
    assert sorted(r.id for r in processed(spark, out).collect()) == list(range(7))
    assert not any(f"{out}/" in p and "run_batch" not in p for p in read)


def test_a_crash_between_the_two_writes(spark, tmp_path, monkeypatch):
    """The output of a batch is stored, its keys are not: the replay overwrites its own part."""
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    spark.range(5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    bucket = incremental._bucket
    monkeypatch.setattr(incremental, "_bucket", lambda key: F.raise_error(
        F.lit("gone")).cast("int"))
    with pytest.raises(Exception, match="gone"):
        incremental_process(spark, src, out, point, "id", lambda d: d, schema)
    assert processed(spark, out).count() == 5
    monkeypatch.setattr(incremental, "_bucket", bucket)
    incremental_process(spark, src, out, point, "id", lambda d: d, schema)
    incremental_process(spark, src, out, str(tmp_path / "lost"), "id", lambda d: d, schema)
    assert sorted(r.id for r in processed(spark, out).collect()) == list(range(5))


def test_only_a_missing_path_is_nothing(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from tripletspark.session import stored
    assert stored(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    with pytest.raises(AnalysisException):
        stored(spark, str(tmp_path / "broken"))  # a folder without a table


def test_live_monitor_drops_late_rows(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    t0 = datetime(2024, 1, 1)
    schema = "ts timestamp, v double"

    def add(rows):
        spark.createDataFrame([(t0 + timedelta(minutes=m), float(v)) for m, v in rows],
                              schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        from pyspark.sql.types import StructType
        stream = spark.readStream.schema(StructType.fromDDL(schema)).parquet(src)
        (live_monitor(stream, "ts", "v", width="10 minutes", lateness="5 minutes").writeStream
         .format("parquet").option("path", out).option("checkpointLocation", point)
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())

    add([(1, 1), (2, 3), (30, 5)])
    run()
    add([(3, 100), (31, 7), (60, 1)])   # the first row is far too late
    run()
    rows = {r.start: (r.n, r["mean"], r["min"], r["max"]) for r in
            spark.read.parquet(out).collect()}
    assert rows[t0] == (2, 2.0, 1.0, 3.0)
    assert rows[t0 + timedelta(minutes=30)] == (2, 6.0, 5.0, 7.0)


def test_live_monitor_on_a_table(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), float(m)) for m in range(20)],
                               "ts timestamp, v double")
    sliding = live_monitor(df, "ts", "v", width="10 minutes", slide="5 minutes")
    assert sliding.filter("n = 10").count() == 3


@pytest.mark.parametrize("parts", [0, 3])
def test_queries_read_a_table_as_a_file_and_as_a_folder(spark, sf, tmp_path, parts):
    """Tables of several part files: a stream over the folder's files used to find nothing."""
    import shutil

    from tripletspark.plans.catalog import REGISTRY
    for name in ("documents", "events"):
        if parts:
            spark.read.parquet(f"{sf}/{name}.parquet").repartition(parts).write.parquet(
                str(tmp_path / f"{name}.parquet"))
        else:
            shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    assert REGISTRY["k1_incremental_process"](spark, str(tmp_path)).count() == 200
    got = REGISTRY["k2_live_monitor"](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{sf}/events.parquet").count()


def test_no_task_holds_a_language(spark, tmp_path):
    """The files of k1_retry_failed are written where the rows are read, several a language."""
    from tripletspark.plans import catalog
    rows = spark.range(600).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 40).alias("text"),
        F.when(F.col("id") % 3 == 0, "de").when(F.col("id") % 5 != 0, "en").alias("lang"))
    rows.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    kept = catalog.incremental_process
    catalog.incremental_process = lambda s, source, *a, **k: (
        seen.append(source), kept(s, source, *a, **k))[1]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        got = catalog.k1_retry_failed(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        catalog.incremental_process = kept
    assert sorted((r.doc_id, r.n) for r in got) == [(i, 40) for i in range(600)]
    files = spark.read.parquet(seen[0]).select("part", F.input_file_name().alias("f")).distinct()
    most = files.groupBy("part").count().collect()
    assert len(most) == 3 and all(r["count"] > 1 for r in most)
