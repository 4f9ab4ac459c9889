"""Streams over the driver's tables, run until all that is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.scratch import scratch_dir
from spanloom.sources.tables import read
from spanloom.streaming import windows as W

STEP, BACK, AHEAD, PAD = 40, 10, 15, 6


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """The rows that a stream appends until it has read all there is, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{scratch_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def carried_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Eight signals of events, in windows of 40 with context on both sides, a padded last one, and a value carried from each to the next."""
    table = read(spark, folder, "events")
    lengths = table.groupBy((F.col("event_id") % 8).alias("rec")).agg((F.max(F.expr("event_id div 8")) + 1).alias("n"))
    stream = spark.readStream.schema(table.schema).parquet(f"{folder}/events.parque[t]")  # a pattern, as a stream takes a plain path for a folder
    rows = stream.select((F.col("event_id") % 8).alias("rec"), F.expr("event_id div 8").alias("pos"), F.rint(F.col("value") * 100).cast("long").alias("value"), F.col("ts").cast("timestamp").alias("ts")).join(F.broadcast(lengths), "rec")  # eight rows
    before = spark.conf.get(W.PROVIDER[0], None)
    try:
        spark.conf.set(*W.PROVIDER)
        return _drained(W.carried_windows(rows, "rec", STEP, BACK, AHEAD, PAD), "windows")
    finally:
        spark.conf.unset(W.PROVIDER[0]) if before is None else spark.conf.set(W.PROVIDER[0], before)


QUERIES = {"carried_windows": carried_windows}

ORACLE_SQL = {
    "carried_windows": f"""WITH RECURSIVE e AS (SELECT event_id % 8 AS rec, event_id // 8 AS pos, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events), n AS (SELECT rec, max(pos) + 1 AS n FROM e GROUP BY rec),
k AS (SELECT rec, n, unnest(range(0, greatest(1, CAST(ceil((n - {AHEAD}) / {STEP}.0) AS BIGINT)))) AS k FROM n), w AS (SELECT *, (k + 1) * {STEP} + {AHEAD} >= n AS last FROM k),
b AS (SELECT rec, k, last, k * {STEP} AS a, CASE WHEN last THEN n ELSE (k + 1) * {STEP} END AS z, greatest(0, k * {STEP} - {BACK}) AS low, CASE WHEN last THEN n ELSE (k + 1) * {STEP} + {AHEAD} END AS high FROM w),
s AS (SELECT b.rec, k, last, a, z, CAST(sum(v) AS BIGINT) AS total, CAST(coalesce(sum(v) FILTER (pos >= a AND pos < z), 0) AS BIGINT) AS own FROM b JOIN e ON e.rec = b.rec AND pos >= low AND pos < high GROUP BY ALL),
r(rec, k, carried, next) AS (SELECT rec, k, 0::BIGINT, own FROM s WHERE k = 0 UNION ALL SELECT s.rec, s.k, r.next, CAST(floor(r.next / 2.0::DOUBLE) AS BIGINT) + s.own FROM r JOIN s ON s.rec = r.rec AND s.k = r.k + 1)
SELECT rec, k AS "window", a AS start, z AS "end", total, CASE WHEN last THEN {PAD}::BIGINT ELSE 0 END AS padded, carried FROM s JOIN r USING (rec, k)""",
}
