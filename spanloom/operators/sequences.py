"""Ordered-row operators: runs, attachment, neighbours, as-of values, moving sums, pages, latest versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[str | Column]


def runs(rows: DataFrame, keys: Sequence[str], order: Order, value: str) -> DataFrame:
    """Adds ``run``, numbered from 1 in each key: consecutive rows with equal values share one (nulls are equal)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_new", starts).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(rows: DataFrame, keys: Sequence[str], time: str, order: Order, gap: int) -> DataFrame:
    """Adds ``session``, numbered from 1: a row more than ``gap`` after the one before begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lag(time).over(w)
    new = F.when(last.isNull() | (F.col(time) - last > gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def moving_sum(rows: DataFrame, keys: Sequence[str], order: Order, value: Column, width: int) -> DataFrame:
    """``moving``: sum over each row and the ``width - 1`` after it; rows without a full window are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = w.rowsBetween(0, width - 1)
    return rows.withColumn("moving", F.sum(value).over(ahead)).withColumn("_n", F.count(F.lit(1)).over(ahead)).where(F.col("_n") == width).drop("_n")


def first_least(rows: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """The first place of the least value of each key."""
    return rows.groupBy(*keys).agg(F.min(F.struct(value, at)).alias("_m")).select(*keys, f"_m.{at}", f"_m.{value}")


def attach(rows: DataFrame, keys: Sequence[str], order: str, positive: Column, text: str) -> DataFrame:
    """Joins the texts of rows that aren't positive to the next positive row; trailing ones to the last.

    One row for each positive row, at its place: ``order`` and the joined ``text``. Keys without a positive row vanish.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_p", F.when(positive, 1).otherwise(0)).withColumn("_group", F.sum("_p").over(back))
    # Counted from the end, trailing rows are group 0 and join group 1, the last positive row.
    grouped = marked.withColumn("_group", F.greatest("_group", F.lit(1)))
    parts = grouped.groupBy(*keys, "_group").agg(
        F.max(F.when(F.col("_p") == 1, F.col(order))).alias(order),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), " ").alias(text),
    )
    return parts.where(F.col(order).isNotNull()).drop("_group")


def neighbours(rows: DataFrame, keys: Sequence[str], order: Order, value: str) -> DataFrame:
    """Adds ``previous`` and ``following`` of the whole list; filter afterwards, as a page's neighbours may be outside it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tie: str, value: str) -> DataFrame:
    """As-of join: each left row with the last right ``value`` at or before it (of equal times the greatest tie)."""
    columns = left.columns
    a = left.withColumn("_kind", F.lit(1)).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, time, F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(time, "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1").select(*columns, "as_of")


def page(rows: DataFrame, order: Order, offset: int, limit: int, greatest: int = 20) -> DataFrame:
    """One page with ``total`` and ``next_offset`` (null on the last page) beside every row of it."""
    if offset < 0 or not 1 <= limit <= greatest:
        raise ValueError(f"offset must not be negative; limit must be 1 to {greatest}")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("long"))
    return cut.join(F.broadcast(total)).withColumn("next_offset", following)  # total is one row


def newest(rows: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The last version of each key: upserts are appended rows, the greatest in ``order`` wins."""
    names = [c for c in rows.columns if c not in keys]
    columns = [o if isinstance(o, Column) else F.col(o) for o in order]
    best = F.max_by(F.struct(*names), F.struct(*columns)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose keys aren't there yet."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def top(rows: DataFrame, keys: Sequence[str], order: Order, n: int) -> DataFrame:
    """The first n rows of each key with their ``rank``; the filter on it lets Spark stop early in each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
