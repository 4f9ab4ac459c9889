"""Checks and repairs of word alignments, as expressions over rows of chunks with their words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerances in seconds: fixed values of the method.
EARLY, LATE = 0.1, 0.2


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid(words: Column, seconds: Column) -> Column:
    """Whether every word's times can be, and one word at least has a length within the audio."""
    def fits(w: Column) -> Column:
        s, e = w["start_time"], w["end_time"]
        return _finite(s) & _finite(e) & (s >= -EARLY) & (s <= e) & (e <= seconds + LATE) & (s < seconds) & (e >= 0)

    measured = F.exists(clipped(words, seconds), lambda w: w["end_time"] > w["start_time"])
    return F.coalesce(F.forall(words, fits) & measured, F.lit(False))


def clipped(words: Column, seconds: Column) -> Column:
    """The words' times held to [0, seconds]."""
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), F.greatest(F.lit(0.0), w["start_time"]).alias("start_time"), F.least(seconds, w["end_time"]).alias("end_time")))


def original_texts(words: Column, text: Column) -> Column:
    """The transcript's own tokens in place of the aligner's, where their numbers agree."""
    own = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    swapped = F.zip_with(words, own, lambda w, t: F.struct(t.alias("text"), w["start_time"].alias("start_time"), w["end_time"].alias("end_time")))
    return F.when(F.size(words) == F.size(own), swapped).otherwise(words)


def measured_words(words: Column) -> Column:
    """Words without length give their text to the next one with length, trailing ones to the last; empty if none has length."""
    step = F.aggregate(
        words,
        F.struct(F.array().cast("array<struct<text:string,start_time:double,end_time:double>>").alias("done"), F.lit("").alias("pending")),
        lambda acc, w: F.when(
            w["end_time"] == w["start_time"], F.struct(acc["done"].alias("done"), F.concat(acc["pending"], w["text"], F.lit(" ")).alias("pending"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(F.struct(F.concat(acc["pending"], w["text"]).alias("text"), w["start_time"].alias("start_time"), w["end_time"].alias("end_time")))).alias("done"), F.lit("").alias("pending"))),
        lambda acc: F.transform(
            acc["done"],
            lambda w, i: F.struct(F.when((i == F.size(acc["done"]) - 1) & (acc["pending"] != ""), F.concat(w["text"], F.lit(" "), F.rtrim(acc["pending"]))).otherwise(w["text"]).alias("text"), w["start_time"].alias("start_time"), w["end_time"].alias("end_time")),
        ),
    )
    return step


def widened(chunks: DataFrame, regions: DataFrame, keys: Sequence[str], by: float = 2.0) -> DataFrame:
    """Chunks with input grown by ``by`` seconds a side within the first region that contains them; ``wider`` tells whether it grew.

    Cores stay. A chunk in no region stays as it is.
    """
    r = regions.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"))
    inside = (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))
    for k in keys:
        inside = inside & (chunks[k] == r[k])
    held = chunks.join(r, inside, "left").drop(*[r[k] for k in keys])
    first = held.groupBy(*chunks.columns).agg(F.min(F.struct("_a", "_b")).alias("_r"))
    held = F.col("_r._a").isNotNull()
    low = F.when(held, F.greatest(F.col("_r._a"), F.col("start") - by)).otherwise(F.col("start"))
    high = F.when(held, F.least(F.col("_r._b"), F.col("end") + by)).otherwise(F.col("end"))
    return first.withColumn("wider", (low < F.col("start")) | (high > F.col("end"))).withColumn("start", low).withColumn("end", high).drop("_r")


def lengths(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number, and least, mean and greatest length of cores and inputs."""
    core, whole = F.col("core_end") - F.col("core_start"), F.col("end") - F.col("start")
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{kind}") for kind, c in (("core", core), ("input", whole)) for name, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])


def progress(chunks: DataFrame, results: DataFrame, keys: Sequence[str], channels: int) -> DataFrame:
    """Completed results and all expected ones (chunks times channels) of each recording."""
    total = chunks.groupBy(*keys).agg((F.count(F.lit(1)) * channels).alias("total"))
    done = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("completed"))
    return total.join(done, list(keys), "left").withColumn("completed", F.coalesce("completed", F.lit(0).cast("long")))
