"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.scratch import materialise, release


def _least(pairs: DataFrame) -> DataFrame:
    """Of each node its least neighbour, written: joins with it are then between plain shuffles, of which Spark splits a hub's."""
    return materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node points its larger neighbours at its least neighbour. Also the table that this reads."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = _least(both)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node points itself and its smaller neighbours at the least of these. Also the table that this reads."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")), least


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked with over any number of steps, for every node with a link.

    ``links`` has two columns of one orderable type; rows with a null or a link to itself say nothing and are left
    out. Each round writes the links to the shared folder, so a lost executor costs one round at most, and only a
    count and a checksum reach the driver. The rounds grow with the logarithm of the longest chain. Neighbours are
    aggregated and written before they are joined, never gathered into one task's memory; a hub's links are split over many tasks.
    """
    links = links.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    links = materialise(links, "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            # Every other node now has one link, to its root; the roots are written once each before they join the rest.
            roots = materialise(links.select(F.col("b").alias("root")).distinct(), "roots")
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("root", "root"))
        state, before = now, links
        star, least = _large_star(links)
        turned = materialise(star.where("a <> b").distinct(), "turned")
        star, lower = _small_star(turned)
        links = materialise(star.where("a <> b").distinct(), "links")
        release(before, turned, least, lower)
