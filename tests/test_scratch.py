"""Scratch tables and connected components."""

from __future__ import annotations

import os
import random
import subprocess
import sys

from spanloom.plans import scratch
from spanloom.plans.components import _large_star, _small_star, components


class _Bare:
    """A session whose checkpoint folder isn't set."""

    def __init__(self, spark):
        self.sparkContext = spark.sparkContext
        self.conf = self

    def get(self, key, default=None):
        return default


def test_folder(spark, tmp_path):
    bare = _Bare(spark)
    made = scratch.scratch_dir(bare)
    assert made.startswith("file://") and scratch.scratch_dir(bare) == made
    spark.range(3).write.parquet(f"{made}/t")
    assert spark.read.parquet(f"{made}/t").count() == 3


def test_tables_are_written_and_released(spark):
    table = scratch.materialise(spark.range(5), "five")
    assert table.count() == 5 and "spanloom/five-" in table.inputFiles()[0]
    assert spark.conf.get(scratch.CLEAN) == "false"
    scratch.release(table)
    assert not spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (5, None), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    expected = {x: find(x) for x in root}
    found = components(spark.createDataFrame(links, "x int, y int")).collect()
    assert {r["node"]: r["root"] for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "x int, y int")).count() == 0


def test_a_hub_is_split(spark):
    """A node with most of the links, where joins may not broadcast: both stars read its links in several tasks."""
    hub = spark.range(1, 200_000).selectExpr("0L AS a", "id AS b").union(spark.range(200_000, 240_000).selectExpr("id AS a", "id + 40000 AS b"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = scratch.materialise(hub.repartition(8), "links")
        down = scratch.materialise(spark.range(1, 200_000).selectExpr("id + 1000000 AS a", "id AS b").union(spark.range(1, 200_000).selectExpr("9000000L AS a", "id AS b")).repartition(8), "down")
        for star, given in ((_large_star, links), (_small_star, down)):
            out, least = star(given)
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString(), star
            scratch.release(least)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_go_with_the_driver(tmp_path):
    code = "from spanloom.session import session\nfrom spanloom.plans.scratch import materialise\ns = session('x', 'local[1]', 1)\nt = materialise(s.range(3), 't')\nprint('AT', t.scratch_path, t.count())\ns.stop()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(scratch.__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": os.path.dirname(root), "TMPDIR": str(tmp_path)})
    path, count = done.stdout.split("AT ")[1].split()
    assert count == "3"
    for _ in range(50):
        if not os.path.exists(path.removeprefix("file://")):
            return
        import time

        time.sleep(0.2)
    raise AssertionError(path)
