"""Reports of runs: rows, seconds, bytes and memory of each stage, gathered in the pass that does the work."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.scratch import materialise
from spanloom.sources.files import size_of, write_json

SCHEMA = "position int, stage string, rows long, seconds double, bytes long, peak_heap_mb double, measures map<string,double>, error string"


@dataclass
class Stage:
    """One stage as it runs: what is watched here is counted when the stage's own write reads it, and not in a pass of its own."""

    spark: SparkSession
    name: str
    began: float = field(default_factory=time.monotonic)
    watched: Observation | None = None
    bytes: int | None = None

    def watch(self, rows: DataFrame, **measures: Column) -> DataFrame:
        """``rows``, of which the count and other sums are taken as they pass."""
        self.watched = Observation(f"{self.name}-{id(self)}")
        return rows.observe(self.watched, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(n) for n, c in measures.items()])

    def kept(self, rows: DataFrame, **measures: Column) -> DataFrame:
        """``rows`` written as a scratch table and watched on the way."""
        table = materialise(self.watch(rows, **measures), self.name)
        self.bytes = size_of(self.spark, table.scratch_path)
        return table


class RunReport:
    """Stages of a run in order; a stage that fails is reported with its error, and those before it stay."""

    def __init__(self, spark: SparkSession, settings: dict | None = None):
        self.spark, self.settings, self.rows = spark, settings or {}, []

    def _heap(self) -> list:
        beans = self.spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
        return [b for b in beans if b.getType().name() == "HEAP"]

    @contextmanager
    def stage(self, name: str) -> Iterator[Stage]:
        for pool in self._heap():
            pool.resetPeakUsage()
        own, error = Stage(self.spark, name), None
        try:
            yield own
        except Exception as e:
            error = f"{type(e).__name__}: {e}".splitlines()[0]
            raise
        finally:
            seen = {} if own.watched is None or error else own.watched.get
            peak = sum(p.getPeakUsage().getUsed() for p in self._heap()) / 1e6
            self.rows.append((len(self.rows), name, seen.get("rows"), time.monotonic() - own.began, own.bytes, peak, {k: v for k, v in seen.items() if k != "rows" and v is not None}, error))

    def table(self) -> DataFrame:
        """A row a stage: rows and measures of what was watched, seconds, bytes of what was kept, and the driver's peak heap."""
        return self.spark.createDataFrame(self.rows, SCHEMA)  # as many rows as stages

    def write(self, path: str) -> None:
        """The settings and the stages as one JSON file, written whole."""
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        write_json(self.spark, path, {"settings": self.settings, "stages": [dict(zip(names, r, strict=True)) for r in self.rows]})
