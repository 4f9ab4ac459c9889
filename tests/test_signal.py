"""Sample expressions against numpy, and segments compared as rows against the plain form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import partitioning as P
from spanloom.operators import signal as G
from spanloom.operators import subtitles as T
from spanloom.operators.reconcile import Word
from spanloom.sources import files


def test_samples(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 5000)).astype(np.float32)
    df = spark.createDataFrame([("r", x.tolist(), y.tolist())], "rec_id string, samples array<float>, other array<float>")
    row = df.select(G.mix(F.col("samples"), F.col("other")).alias("m"), G.excerpt(F.col("samples"), F.lit(0.1), F.lit(0.2)).alias("e")).first()
    assert np.allclose(row["m"], (x + y) / 2, atol=1e-6) and np.allclose(row["e"], x[1600:3200])
    rows = G.frames(df).orderBy("frame").collect()
    assert len(rows) == 32 and np.allclose([r["energy"] for r in rows], [np.sum(x[i : i + 160].astype(float) ** 2) for i in range(0, 5000, 160)])
    assert G.preview(G.frames(df), 0.1).count() == 10
    cut = G.quietest(G.frames(df), ["rec_id"], F.lit(0), F.lit(31)).first()["cut"]
    assert abs(cut - P.Signal(x).quietest(0, 31 * 160 / 16000)) < 1e-9


def test_compared_rows(spark):
    chunks = [{"start": 0, "end": 11, "core_start": 0.0, "core_end": 10.0}, {"start": 9, "end": 20, "core_start": 10.0, "core_end": 20.0}]
    words = {"A": [(1, 2, "ряд"), (9.8, 10.4, "где"), (25, 26, "конец")], "B": [(1, 2, "ряда"), (11, 12, "где")]}
    texts = {"A": ["x", "y"], "B": ["z", ""]}
    plain = T.compare(chunks, {c: {"words": [Word(a, b, t, 0, True, {0}) for a, b, t in w], "transcripts": [{"text": t, "confidence": None} for t in texts[c]]} for c, w in words.items()})
    w = spark.createDataFrame([("r", c, i, float(a), float(b), t) for c, own in words.items() for i, (a, b, t) in enumerate(own)], "rec_id string, channel string, pos int, start double, end double, text string")
    k = spark.createDataFrame([("r", i, c["core_start"], c["core_end"]) for i, c in enumerate(chunks)], "rec_id string, chunk_idx int, core_start double, core_end double")
    t = spark.createDataFrame([("r", c, i, x) for c, own in texts.items() for i, x in enumerate(own)], "rec_id string, channel string, chunk_idx int, text string")
    for row, segment in zip(T.compare_rows(w, k, t).orderBy("chunk_idx").collect(), plain, strict=True):
        assert row["id"] == segment["id"]
        assert {c: (v["text"], v["input_text"]) for c, v in row["variants"].items()} == {c: (v["text"], v["input_text"]) for c, v in segment["variants"].items()}
        assert [d.asDict() for d in row["conflicts"]] == segment["conflicts"]
    mono = T.compare_rows(w.where("channel = 'A'"), k, t.where("channel = 'A'")).collect()
    assert [r["conflicts"] for r in mono] == [[], []]


def test_changed_files(spark, tmp_path):
    files.write_text(spark, f"file://{tmp_path}/a.txt", "one")
    good = files.digests(spark, f"file://{tmp_path}/*.txt").first()["sha256"]
    expected = spark.createDataFrame([("a.txt", good), ("b.txt", good)], "name string, sha256 string")
    assert [r["name"] for r in files.changed(spark, f"file://{tmp_path}/*.txt", expected).collect()] == ["b.txt"]
