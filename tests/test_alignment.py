"""Alignment checks, requests and job states."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import alignment as A
from spanloom.operators import review
from spanloom.sources import requests
from spanloom.sources.store import Store

WORDS = "array<struct<text:string,start_time:double,end_time:double>>"
INF = float("inf")


@pytest.mark.parametrize(
    "words, fine",
    [
        ([("a", 0.0, 0.5), ("b", 0.5, 1.15)], True), ([("a", -0.1, 0.2)], True), ([], False), (None, False), ([("a", 0.3, 0.2)], False), ([("a", 0.0, 1.3)], False),
        ([("a", 1.0, 1.1)], False), ([("a", -0.1, -0.05)], False), ([("a", 0.2, 0.2)], False), ([("a", float("nan"), 1.0)], False), ([("a", 0.0, INF)], False),
    ],
)
def test_valid(spark, words, fine):
    df = spark.createDataFrame([(words, 1.0)], f"w {WORDS}, s double")
    assert df.select(A.valid(F.col("w"), F.col("s"))).first()[0] is fine


def _texts(spark, words, column):
    return [(w["text"], w["start_time"], w["end_time"]) for w in spark.createDataFrame([(words, "Раз, два!")], f"w {WORDS}, t string").select(column).first()[0]]


def test_repairs(spark):
    words = [("раз", 0.0, 0.5), ("два", 0.5, 1.0)]
    assert [w[0] for w in _texts(spark, words, A.original_texts(F.col("w"), F.col("t")))] == ["Раз,", "два!"]
    assert [w[0] for w in _texts(spark, words[:1], A.original_texts(F.col("w"), F.col("t")))] == ["раз"]
    mixed = [("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, 2.0), ("d", 2.0, 2.0), ("e", 2.0, 2.0)]
    assert _texts(spark, mixed, A.measured_words(F.col("w"))) == [("a b", 0.0, 1.0), ("c d e", 1.0, 2.0)]
    assert _texts(spark, [("a", 1.0, 1.0)], A.measured_words(F.col("w"))) == []


def test_widened_and_lengths(spark):
    chunks = spark.createDataFrame([("r", 0, 10.0, 20.0, 11.0, 19.0), ("r", 1, 50.0, 60.0, 51.0, 59.0)], "rec string, i int, start double, end double, core_start double, core_end double")
    regions = spark.createDataFrame([("r", 9.0, 30.0)], "rec string, a double, b double")
    out = {r["i"]: (r["start"], r["end"], r["wider"]) for r in A.widened(chunks, regions, ["rec"]).collect()}
    assert out == {0: (9.0, 22.0, True), 1: (50.0, 60.0, False)}
    row = A.lengths(chunks, ["rec"]).first()
    assert (row["n"], row["least_core"], row["mean_input"]) == (2, 8.0, 10.0)
    assert A.progress(chunks, chunks.limit(1), ["rec"], 2).first().asDict() == {"rec": "r", "total": 4, "completed": 1}


def test_token_places(spark):
    out = spark.createDataFrame([("Ёж—Straße",), (None,)], "t string").select(X.tokens_with_places("t")).collect()
    assert [tuple(t) for t in out[0][0]] == [("еж", 0, 2), ("strasse", 3, 9)] and out[1][0] == []


def test_requests(spark, tmp_path):
    assert not requests.errors("general", ["general"], terms=["a"] * 500, speaker=7, limit_seconds=1)
    for bad in ({"terms": ["a"] * 501}, {"terms": [" "]}, {"terms": ["x" * 151]}, {"speaker": 8}, {"speaker": True}, {"limit_seconds": 0.5}, {"limit_seconds": INF}, {"context": "x" * 20_001}):
        assert len(requests.errors("general", ["general"], **bad)) == 1
    store = Store(spark, f"file://{tmp_path}/s")
    job, new = requests.start(store, "/a", "general", ["general"], terms=["b", "a"])
    assert new and requests.start(store, "/a", "general", ["general"], terms=["a", "b", "a"]) == (job, False)
    with pytest.raises(ValueError):
        requests.retry(store, job)
    requests.cancel(store, job)
    requests.retry(store, job)
    assert store.state(job)["status"] == "queued"


def test_clips_and_raw_pages(spark):
    assert not review.clip_errors(0, 120, 200) and len(review.clip_errors(0, 121, 200)) == 1 and len(review.clip_errors(5, 6, 10, "B", 1)) == 1
    rows = spark.createDataFrame([("j", "A", i, f"t{i}") for i in range(3)], "job string, channel string, chunk_idx int, text string")
    page = review.get_raw_transcripts(rows, "j", "A", 1, 1)
    assert page["transcripts"][0]["text"] == "t1" and page["next_offset"] == 2 and page["total"] == 3
    with pytest.raises(ValueError):
        review.get_raw_transcripts(rows, "j", "B")
