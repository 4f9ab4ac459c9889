"""Streams over files, against their batch forms."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom.sources.files import StageCache
from spanloom.streaming import streams as S


def _source(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch."""
    folder = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, tmp_path, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_sessions_join_over_the_gap(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", t0), ("u", t0 + timedelta(seconds=10)), ("u", t0 + timedelta(seconds=21)), ("u", t0 + timedelta(hours=5))]
    stream = _source(spark, tmp_path, [rows], "k string, ts timestamp")
    _run(S.sessions(stream, "k", "ts", "10 seconds", "1 minute"), tmp_path, "append", "sess")
    assert sorted(r["n"] for r in spark.table("sess").collect()) == [1, 2]


def test_late_rows_are_dropped(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    batches = [[("u", t0), ("u", t0 + timedelta(hours=2))], [("u", t0 + timedelta(hours=4))], [("u", t0 + timedelta(minutes=1))], [("u", t0 + timedelta(hours=9))]]
    stream = _source(spark, tmp_path, batches, "k string, ts timestamp")
    _run(S.tumbling(stream, "k", "ts", "1 hour", "10 minutes"), tmp_path, "append", "tumb")
    assert sum(r["n"] for r in spark.table("tumb").collect()) <= 4


def test_spans_merge_with_state(spark, tmp_path):
    rows = [("r", 0, 10, False), ("r", 12, 20, False), ("r", 20, 21, True), ("r", 22, 30, False), ("r", 60, 70, False), ("r", 80, 81, True)]
    stream = _source(spark, tmp_path, [rows], "k string, a long, b long, barrier boolean")
    _run(S.merged_spans(stream, "k", 5), tmp_path, "append", "spans")
    assert sorted((r["a"], r["b"]) for r in spark.table("spans").collect()) == [(0, 20), (22, 30), (60, 70)]


def test_latest_by_key(spark, tmp_path):
    stream = _source(spark, tmp_path, [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]], "k string, revision int, v string")
    _run(S.latest(stream, "k", "revision", "v"), tmp_path, "complete", "latest")
    assert {r["k"]: r["v"] for r in spark.table("latest").collect()} == {"a": "z", "b": "y"}


def test_work_resumes_by_key(spark, tmp_path):
    cache = StageCache(spark, f"file://{tmp_path}/cache", "n long")
    seen = []

    def work(rows):
        seen.append(rows.count())
        return rows.select("key_sha", F.length("key_sha").cast("long").alias("n"))

    batch = S.resumable(cache, "asr", work)
    stream = _source(spark, tmp_path, [[("a",), ("bb",), ("a",)]], "key_sha string")
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch(spark.createDataFrame([("bb",), ("ccc",)], "key_sha string"), 1)
    assert {r["key_sha"]: r["n"] for r in cache.read("asr").collect()} == {"a": 1, "bb": 2, "ccc": 3} and seen[-1] == 1
