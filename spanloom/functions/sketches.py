"""Sketches of distinct values and of quantiles that are kept by partition and united later, with the errors that they are held to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches, and errors that they stay within: of a count, as a share of it, and of a quantile's rank, as a share of all rows.
DISTINCT_LOG, DISTINCT_ERROR = 14, 0.03
QUANTILE_SIZE, RANK_ERROR = 800, 0.0165


def distinct_sketches(rows: DataFrame, parts: Sequence[str], column: str) -> DataFrame:
    """parts and ``sketch`` of the distinct values of a column: some kilobytes, however many rows. Nulls don't count."""
    return rows.groupBy(*parts).agg(F.hll_sketch_agg(column, F.lit(DISTINCT_LOG)).alias("sketch"))


def distinct_counts(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and ``estimate`` of the distinct values of all parts of each key."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def quantile_sketches(rows: DataFrame, parts: Sequence[str], column: str) -> DataFrame:
    """parts, ``sketch`` of a column's numbers and ``n`` of them. Nulls don't count."""
    value = F.col(column).cast("double")
    return rows.groupBy(*parts).agg(F.kll_sketch_agg_double(value, F.lit(QUANTILE_SIZE)).alias("sketch"), F.count(value).alias("n"))


def quantiles(sketches: DataFrame, keys: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """keys, n, rank and ``value`` of each rank, over all parts of each key."""
    united = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(QUANTILE_SIZE)).alias("sketch"), F.sum("n").alias("n")).where("n > 0")
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("value")) for r in ranks]))
    return united.select(*keys, "n", each.alias("q")).select(*keys, "n", "q.rank", "q.value")
