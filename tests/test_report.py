"""Reports of runs, and outputs that never replace their source."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spanloom.plans.report import RunReport
from spanloom.sources import files


def test_stages_are_counted_as_they_run(spark, tmp_path):
    report = RunReport(spark, {"core": 28})
    with report.stage("even") as stage:
        even = stage.kept(spark.range(1000).where("id % 2 = 0"), total=F.sum("id"))
    with report.stage("seen") as stage:
        assert stage.watch(even.where("id > 10")).count() == 494
    with report.stage("bare"):
        pass
    with pytest.raises(RuntimeError), report.stage("broken") as stage:
        stage.watch(even)
        raise RuntimeError("gone")
    rows = {r["stage"]: r for r in report.table().collect()}
    assert (rows["even"]["rows"], rows["even"]["measures"]["total"]) == (500, 249500.0) and rows["even"]["bytes"] == files.size_of(spark, even.scratch_path) > 0
    assert rows["seen"]["rows"] == 494 and rows["seen"]["bytes"] is None and rows["bare"]["rows"] is None
    assert rows["broken"]["error"] == "RuntimeError: gone" and all(r["seconds"] >= 0 and r["peak_heap_mb"] > 0 for r in rows.values())
    report.write(f"file://{tmp_path}/run.json")
    written = files.read_json(spark, f"file://{tmp_path}/run.json")
    assert written["settings"] == {"core": 28} and [s["stage"] for s in written["stages"]] == ["even", "seen", "bare", "broken"]


def test_a_source_is_never_replaced(spark, tmp_path):
    source = f"{tmp_path}/a.txt"
    files.write_text(spark, f"file://{source}", "words")
    os.symlink(source, f"{tmp_path}/link.txt")
    for same in (source, f"file://{source}", f"file://{tmp_path}/x/../a.txt", f"file://{tmp_path}/link.txt"):
        with pytest.raises(ValueError, match="source"):
            files.write_beside(spark, same, "cues", source)
    files.write_beside(spark, f"file://{tmp_path}/a.srt", "cues", source)
    assert files.read_text(spark, source) == "words" and files.read_text(spark, f"{tmp_path}/a.srt") == "cues"
