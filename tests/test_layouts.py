"""Layouts over frame rows against the walk over one recording's samples, and against their own limits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import layouts as L
from spanloom.operators import partitioning as P

UNIT = P.STEP


def _noise(rng, n):
    """Integer energies a frame, with quiet stretches and many ties."""
    e = rng.integers(1, 9, size=n)
    for _ in range(n // 60):
        at = rng.integers(0, n)
        e[at : at + rng.integers(1, 25)] = 0
    return e


def _signal(energies):
    """Samples whose frames have these energies: one sample of each carries it."""
    x = np.zeros(len(energies) * UNIT)
    x[::UNIT] = np.sqrt(energies)
    s = P.Signal([])
    s.size = len(x)
    s.energy = np.concatenate([[0.0], np.cumsum(np.repeat(energies, 1))]).repeat(1)
    s.energy = np.concatenate([[0.0], np.cumsum(np.where(np.arange(len(x)) % UNIT == 0, np.repeat(energies, UNIT), 0)).astype(float)])
    return s


def _frames(spark, recordings):
    return spark.createDataFrame([(k, i, float(v)) for k, e in recordings.items() for i, v in enumerate(e.tolist())], "rec string, frame long, energy double")


def _rows(df):
    found = {}
    for r in df.orderBy("rec", "region", "chunk_idx").collect():
        found.setdefault((r["rec"], r["region"]), []).append(tuple(round(r[c], 6) for c in ("start", "end", "core_start", "core_end")))
    return found


def _plain(chunks):
    return [tuple(round(x, 6) for x in (c.start, c.end, c.core_start, c.core_end)) for c in chunks]


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(1)
    return {f"r{i}": _noise(rng, n) for i, n in enumerate([5, 150, 300, 301, 1200, 2500])}


@pytest.mark.parametrize("block", [L.BLOCK, 400])
def test_regions(spark, recordings, block):
    rng = np.random.default_rng(2)
    regions = {k: sorted(rng.choice(len(e) + 1, size=min(4, len(e) // 2 * 2), replace=False).tolist()) for k, e in recordings.items()}
    given = spark.createDataFrame([(k, a, b) for k, x in regions.items() for a, b in zip(x[::2], x[1::2], strict=True)], "rec string, a long, b long")
    for most in (1.5, 3.0):
        got = _rows(L.region_chunks(_frames(spark, recordings), given, ["rec"], most, 8.0, block))
        expected = {(k, a): _plain(P.region_layout(_signal(recordings[k]), [(a / 100, b / 100)], most)) for k, x in regions.items() for a, b in zip(x[::2], x[1::2], strict=True)}
        assert got == expected


@pytest.mark.parametrize("block", [L.BLOCK, 400])
def test_sliding(spark, recordings, block):
    limits = spark.createDataFrame([(k, len(e)) for k, e in recordings.items()], "rec string, n long")
    speech = spark.createDataFrame([(k, a, a + 30) for k, e in recordings.items() for a in range(0, len(e), 700)], "rec string, a long, b long")
    got = _rows(L.sliding_chunks(_frames(spark, recordings), limits, speech, ["rec"], 3.0, 1.2, block))
    for k, e in recordings.items():
        spans = [(a / 100, (a + 30) / 100) for a in range(0, len(e), 700)]
        assert got[k, 0] == _plain(P.sliding_layout(_signal(e), len(e) / 100, spans, 3.0, 1.2)), k


@pytest.mark.parametrize("least, most, search", [(1.0, 2.5, 0.8), (2.0, 2.4, 8.0), (2.0, 2.05, 1.0), (1.2, 1.2, 0.5), (0.5, 3.0, 1.0)])
@pytest.mark.parametrize("block", [L.BLOCK, 400])
def test_packed(spark, least, most, search, block):
    rng = np.random.default_rng(3)
    high = round(most * 100)
    sizes = [7, high - 1, high, high + 1, 3 * high - 2, 3 * high, 3 * high + 4, 5 * high - 25, *rng.integers(high, 9 * high, size=6).tolist()]
    recordings = {f"r{i}": _noise(rng, n) for i, n in enumerate(sizes)}
    limits = spark.createDataFrame([(k, len(e)) for k, e in recordings.items()], "rec string, n long")
    everywhere = spark.createDataFrame([(k, 0, 100_000) for k in recordings], "rec string, a long, b long")
    got = _rows(L.packed_chunks(_frames(spark, recordings), limits, everywhere, ["rec"], least, most, search, block))
    for k, e in recordings.items():
        size = P.Packing.of(len(e) * UNIT, least, most).size
        whole = np.zeros(size // UNIT)
        whole[: len(e)] = e
        assert got[k, 0] == _plain(P.packed_layout(_signal(whole), [(0, 1e6)], least, most, search)), (k, len(e))


def test_packed_leaves_out_silence(spark):
    rng = np.random.default_rng(5)
    e = _noise(rng, 2000)
    limits = spark.createDataFrame([("x", 2000)], "rec string, n long")
    speech = spark.createDataFrame([("x", 950, 1100)], "rec string, a long, b long")
    got = _rows(L.packed_chunks(_frames(spark, {"x": e}), limits, speech, ["rec"], 1.0, 2.5))
    assert got["x", 0] == _plain(P.packed_layout(_signal(e), [(9.5, 11.0)], 1.0, 2.5)) and 0 < len(got["x", 0]) < 8


def test_splitting(spark, recordings):
    chunks = [("r4", 0, 0.0, 9.0, 0.5, 8.5), ("r4", 1, 7.5, 12.0, 8.5, 11.0), ("r5", 0, 0.0, 25.0, 0.0, 25.0), ("r5", 1, 3.0, 6.2, 3.0, 5.0 + 0.02)]
    given = spark.createDataFrame(chunks, "rec string, chunk_idx int, start double, end double, core_start double, core_end double")
    rows = L.split_chunks(_frames(spark, recordings), given, ["rec"]).orderBy("rec", "chunk_idx", "part").collect()
    got = [tuple(round(r[c], 6) for c in ("start", "end", "core_start", "core_end")) for r in rows]
    assert got == [x for k, _, *c in chunks for x in _plain(P.halved(_signal(recordings[k]), P.Chunk(*c)))]
    with pytest.raises(Exception, match="too short"):
        L.split_chunks(_frames(spark, recordings), given.withColumn("core_end", F.col("core_start") + 1.5), ["rec"]).collect()


def test_splitting_in_parts():
    own = P.Chunk(0.0, 20.0, 2.5, 18.0)
    parts = P.divided(own, [6.0, 11.0])
    assert [(c.core_start, c.core_end) for c in parts] == [(2.5, 6.0), (6.0, 11.0), (11.0, 18.0)]
    assert [(c.start, c.end) for c in parts] == [(0.0, 7.0), (5.0, 12.0), (10.0, 20.0)]


def test_silenced_frames(spark, recordings):
    spans = {"r1": [(10, 20), (15, 30), (140, 900)], "r5": [(0, 1), (2400, 2450)]}
    given = spark.createDataFrame([(k, a, b) for k, x in spans.items() for a, b in x], "rec string, a long, b long")
    rows = L.silenced(_frames(spark, recordings), given, ["rec"], 64).collect()
    assert len(rows) == sum(map(len, recordings.values()))
    for r in rows:
        covered = any(a <= r["frame"] < b for a, b in spans.get(r["rec"], []))
        assert r["energy"] == (0 if covered else recordings[r["rec"]][r["frame"]])


def test_bad_layout_limits(spark, recordings):
    frames = _frames(spark, {"r0": recordings["r0"]})
    limits = spark.createDataFrame([("r0", 5)], "rec string, n long")
    regions = spark.createDataFrame([("r0", 0, 5)], "rec string, a long, b long")
    for bad in (0.0, 0.1, 1.2345):
        with pytest.raises(ValueError):
            L.region_chunks(frames, regions, ["rec"], bad)
    for least, most in ((2.0, 1.0), (0.0, 1.0)):
        with pytest.raises(ValueError):
            L.packed_chunks(frames, limits, regions, ["rec"], least, most)
