"""Named Parquet tables of a folder, and the transcript shapes that the driver's tables stand in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table by name; only Spark's reader touches the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str | Column) -> Column:
    """Microseconds of a timestamp without zone, read in UTC."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Events as diarization segments: rec, speaker, and a span [a, b) in frames of 10 ms."""
    e = read(spark, folder, "events")
    a = F.floor(micros("ts") / 10000)
    own = e.select((F.col("user_id") % 20).alias("rec"), (F.col("user_id") % 8).alias("speaker"), "event_id", "user_id", "event_type", a.alias("a"), (a + 100 * F.rint("value").cast("long")).alias("b"))
    return own.where("b > a")


def limits(spans: DataFrame, *keys: str) -> DataFrame:
    """``n``, the end of each key's timeline."""
    return spans.groupBy(*keys).agg(F.max("b").alias("n"))
