"""Interval algebra on half-open integer spans, as ordered passes.

All functions take DataFrames with key columns (for example a recording), and the columns ``a`` and ``b`` of a span
[a, b). Spans with b <= a are empty and dropped. Keys may be any number of columns.

An ordered pass is one window a key, or, given a ``block`` (a length in the spans' own unit), one a key and block of time: what the
blocks before or after hand over is then worked out on one row a block. A key with a third of all spans is so as many tasks as it has
blocks. Spans aren't cut at the blocks' edges, so a long one is one row like any other; the results don't depend on the block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.scratch import materialise

Keys = Sequence[str]
#: Frames of 10 ms in a day, a block for recordings that go on for long, and spans of one key from which blocks are worth their cost.
DAY, HOT = 8_640_000, 2_000_000


@dataclass(frozen=True)
class Running:
    """What an ordered pass hands on of a column: its ``max``, ``sum`` or ``last`` value that isn't null.

    ``back``: from the end to the beginning; ``own``: with the row itself.
    """

    column: str
    kind: str
    back: bool = False
    own: bool = True

    def over(self, column: str, window) -> Column:
        c = F.col(column)
        return {"max": F.max, "sum": F.sum, "last": lambda x: F.last(x, ignorenulls=True)}[self.kind](c).over(window)

    def of_block(self, order: Sequence[str]) -> Column:
        c = F.col(self.column)
        if self.kind != "last":
            return {"max": F.max, "sum": F.sum}[self.kind](c)
        at = F.when(c.isNotNull(), F.struct(*order))
        return F.min_by(c, at) if self.back else F.max_by(c, at)

    def joined(self, carried: Column, local: Column) -> Column:
        if self.kind == "max":
            return F.greatest(carried, local)
        if self.kind == "sum":
            return F.when(carried.isNotNull() | local.isNotNull(), F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0)))
        return F.coalesce(local, carried)


def running(rows: DataFrame, keys: Keys, order: Sequence[str], block: int | None = None, **wanted: Running) -> DataFrame:
    """The rows with a column for each of ``wanted``, by the order of columns of which the first is a time."""

    def window(names: Sequence[str], by: Sequence[str], r: Running):
        ordered = Window.partitionBy(*names).orderBy(*[F.desc(c) if r.back else F.asc(c) for c in by])
        return ordered.rowsBetween(Window.unboundedPreceding, 0 if r.own else -1)

    if block is None:
        return rows.select("*", *[r.over(r.column, window(keys, order, r)).alias(n) for n, r in wanted.items()])
    names, own = [*keys, "_block"], rows.columns
    dealt = rows.withColumn("_block", F.floor(F.col(order[0]) / block).cast("long"))
    sums = dealt.groupBy(*names).agg(*[r.of_block(order).alias(f"_of_{n}") for n, r in wanted.items()])
    before = lambda r: window(keys, ["_block"], Running(r.column, r.kind, r.back, False))
    carried = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], *[r.over(f"_of_{n}", before(r)).alias(f"_before_{n}") for n, r in wanted.items()])
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    local = dealt.join(carried, same, "left").select(*own, "_block", *[f"_before_{n}" for n in wanted], *[r.over(r.column, window(names, order, r)).alias(f"_in_{n}") for n, r in wanted.items()])
    return local.select(*own, *[r.joined(F.col(f"_before_{n}"), F.col(f"_in_{n}")).alias(n) for n, r in wanted.items()])


def block_for(spans: DataFrame, keys: Keys, block: int = DAY, most: int = HOT) -> int | None:
    """``block`` if a key has more than ``most`` spans, else None: one window a key is then quicker, with the same result."""
    greatest = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return block if (greatest or 0) > most else None


def _runs(marked: DataFrame, keys: Keys, block: int | None) -> DataFrame:
    """Spans in order, united from each one with ``_first`` (its a; null in the others) to the next."""
    started = running(marked, keys, ["a", "b"], block, _start=Running("_first", "max"))
    return started.groupBy(*keys, "_start").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_start")


def islands(spans: DataFrame, keys: Keys, gap: int = 0, block: int | None = None) -> DataFrame:
    """Union of the spans of each key: maximal runs, where touching spans (and gaps up to ``gap``) run on."""
    reached = running(spans.where("b > a").select(*keys, "a", "b"), keys, ["a", "b"], block, _reach=Running("b", "max", own=False))
    first = F.when(F.col("_reach").isNull() | (F.col("a") > F.col("_reach") + gap), F.col("a"))
    return _runs(reached.select(*keys, "a", "b", first.alias("_first")), keys, block)


def covered(spans: DataFrame, keys: Keys, block: int | None = None) -> DataFrame:
    """``total`` of each key: the length covered, overlaps counted once."""
    return islands(spans, keys, block=block).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("total"))


def dominant(totals: DataFrame, keys: Keys, item: str) -> DataFrame:
    """The item of greatest total of each key; the least item on a tie, null after all others. Items may be of any type with an order."""
    best = F.min(F.struct((-F.col("total")).alias("_minus"), F.col(item).isNull().alias("_none"), F.col(item))).alias("_best")
    return totals.groupBy(*keys).agg(best).select(*keys, F.col(f"_best.{item}").alias(item), (-F.col("_best._minus")).alias("total"))


def difference(left: DataFrame, right: DataFrame, keys: Keys, block: int | None = None) -> DataFrame:
    """The parts of the left spans that no right span covers, as maximal runs: a sweep over the boundaries."""
    def edges(spans: DataFrame, side: str, other: str) -> DataFrame:
        own = spans.where("b > a")
        up = own.select(*keys, F.col("a").alias("t"), F.lit(1).alias(side), F.lit(0).alias(other))
        return up.unionByName(own.select(*keys, F.col("b").alias("t"), F.lit(-1).alias(side), F.lit(0).alias(other)))

    moves = edges(left, "_l", "_r").unionByName(edges(right, "_r", "_l")).groupBy(*keys, "t").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    swept = running(moves, keys, ["t"], block, _left=Running("_l", "sum"), _right=Running("_r", "sum"), b=Running("t", "last", back=True, own=False))
    return islands(swept.where("_left > 0 AND _right = 0 AND b IS NOT NULL").select(*keys, F.col("t").alias("a"), "b"), keys, block=block)


def barrier_before(spans: DataFrame, barriers: DataFrame, keys: Keys, block: int | None = None) -> DataFrame:
    """Adds ``before``, the last barrier end at or before a, and ``after``, the first barrier start at or after b.

    One ordered pass over the union of both sides a direction, instead of a range join.
    """
    def walk(spans: DataFrame, at: str, edge: str, name: str, reverse: bool) -> DataFrame:
        extra = [c for c in spans.columns if c not in keys]
        # At one time barriers come first, whichever way the pass goes.
        marks = spans.select("*", F.col(at).alias("_t"), F.lit(0 if reverse else 1).alias("_kind"), F.lit(None).cast("long").alias("_edge"), F.lit(True).alias("_span"))
        nothing = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in extra]
        walls = barriers.select(*keys, *nothing, F.col(edge).alias("_t"), F.lit(1 if reverse else 0).alias("_kind"), F.col(edge).cast("long").alias("_edge"), F.lit(False).alias("_span"))
        both = running(marks.unionByName(walls), keys, ["_t", "_kind"], block, **{name: Running("_edge", "last", back=reverse)})
        return both.where("_span").drop("_t", "_kind", "_edge", "_span")

    return walk(walk(spans, "a", "b", "before", False), "b", "a", "after", True)


def padded(spans: DataFrame, barriers: DataFrame, keys: Keys, pad: int, limit: str, block: int | None = None) -> DataFrame:
    """Spans grown by ``pad`` a side into silence, stopped by barriers and by [0, limit), then united."""
    found = barrier_before(spans, barriers, keys, block)
    low = F.greatest(F.lit(0), F.col("a") - pad, F.coalesce("before", F.lit(0)))
    high = F.least(F.col(limit), F.col("b") + pad, F.coalesce("after", F.col(limit)))
    return islands(found.select(*keys, low.alias("a"), high.alias("b")), keys, block=block)


def gap_merged(spans: DataFrame, barriers: DataFrame, keys: Keys, gap: int, block: int | None = None) -> DataFrame:
    """Disjoint spans merged over gaps up to ``gap``, unless a barrier lies in the gap."""
    found = running(barrier_before(spans, barriers, keys, block), keys, ["a"], block, _last=Running("b", "last", own=False))
    broken = F.col("_last").isNull() | (F.col("a") - F.col("_last") > gap) | (F.coalesce("before", F.lit(-1)) > F.col("_last"))
    return _runs(found.select(*keys, "a", "b", F.when(broken, F.col("a")).alias("_first")), keys, block)


def dominant_regions(segments: DataFrame, limits: DataFrame, keys: Keys, item: str, gap: int = 80, pad: int = 20, chosen: int | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(dominant item and total of each key, its regions).

    ``limits`` has the keys and ``n``, the length of the timeline. Regions are the item's spans, padded into silence
    and merged over short gaps, never across a stretch where only others are active. ``chosen`` names the item instead of the
    dominant one; a key in which it isn't active gets no regions.
    """
    # Tables between the steps: each is read several times, and far smaller than the segments.
    united = materialise(islands(segments, [*keys, item], block=block), "united")
    totals = united.groupBy(*keys, item).agg(F.sum(F.col("b") - F.col("a")).alias("total"))
    best = dominant(totals, keys, item) if chosen is None else totals.where(F.col(item) == chosen)
    best = materialise(best, "dominant")
    marked = united.join(best.select(*keys, F.col(item).alias("_best")), list(keys))
    own = marked.where(F.col(item) == F.col("_best")).select(*keys, "a", "b")
    others = marked.where(F.col(item) != F.col("_best")).select(*keys, "a", "b")
    walls = materialise(difference(others, own, keys, block), "walls")
    grown = materialise(padded(own.join(limits, list(keys)), walls, keys, pad, "n", block), "grown")
    return best, gap_merged(grown, walls, keys, gap, block)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b) and [c, d) share a point; touching spans don't, null bounds never do."""
    return (a < d) & (c < b)


def overlap_join(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Pairs of overlapping spans with equal keys: an equi join with the overlap as residual. Right bounds are c and d."""
    condition = overlaps(F.col("l.a"), F.col("l.b"), F.col("r.c"), F.col("r.d"))
    for k in keys:
        condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    joined = left.alias("l").join(right.alias("r"), condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[F.col(f"r.{k}") for k in keys])


def bucketed_overlap_join(left: DataFrame, right: DataFrame, keys: Keys, width: int) -> DataFrame:
    """As overlap_join, for keys with very many spans: spans meet by buckets of ``width``, each pair in one bucket alone."""
    def dealt(spans: DataFrame, a: str, b: str) -> DataFrame:
        bucket = F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
        return spans.where(F.col(b) > F.col(a)).withColumn("_bucket", bucket)

    once = F.col("l._bucket") == F.floor(F.greatest("l.a", "r.c") / width)
    condition = overlaps(F.col("l.a"), F.col("l.b"), F.col("r.c"), F.col("r.d")) & once & (F.col("l._bucket") == F.col("r._bucket"))
    for k in keys:
        condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    joined = dealt(left, "a", "b").alias("l").join(dealt(right, "c", "d").alias("r"), condition)
    return joined.drop(*[F.col(f"r.{k}") for k in keys], F.col("l._bucket"), F.col("r._bucket"))


def locate(points: DataFrame, spans: DataFrame, keys: Keys, point: str, point_id: str, span_id: str, block: int | None = None) -> DataFrame:
    """The first span that holds each point; where none does, the one whose edge is nearest, first on a tie.

    Spans are disjoint in a key, so only the nearest start at or before the point and the next one matter: two ordered
    passes find them without pairing points with all spans.
    """
    none = F.lit(None)
    marks = points.select(*keys, F.col(point).alias("_t"), F.lit(1).alias("_kind"), F.col(point_id).alias("_p"), none.cast("struct<a:bigint,b:bigint,i:bigint>").alias("_s"))
    span = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col(span_id).cast("long").alias("i"))
    walls = spans.where("b > a").select(*keys, F.col("a").alias("_t"), F.lit(0).alias("_kind"), none.cast(points.schema[point_id].dataType).alias("_p"), span.alias("_s"))
    passes = {"_before": Running("_s", "last"), "_after": Running("_s", "last", back=True, own=False)}
    seen = running(marks.unionByName(walls), keys, ["_t", "_kind"], block, **passes).where("_kind = 1")

    def outside(s: str) -> Column:
        inside = (F.col(f"{s}.a") <= F.col("_t")) & (F.col("_t") < F.col(f"{s}.b"))
        far = F.least(F.abs(F.col("_t") - F.col(f"{s}.a")), F.abs(F.col("_t") - F.col(f"{s}.b")))
        return F.when(F.col(s).isNotNull(), F.struct(F.when(inside, 0).otherwise(1).alias("outside"), F.when(inside, 0).otherwise(far).cast("long").alias("distance"), F.col(f"{s}.i").alias("i")))

    best = F.least(outside("_before"), outside("_after"))
    return seen.select(*keys, F.col("_p").alias(point_id), F.col("_t").alias(point), best["i"].alias(span_id), best["outside"].alias("outside"), best["distance"].alias("distance"))


def overlap_list(left: DataFrame, right: DataFrame, keys: Keys, left_id: str, right_id: str) -> DataFrame:
    """Every left row with the ordered list of right ids whose spans overlap it; an empty list where none does."""
    pairs = overlap_join(left.select(*keys, left_id, "a", "b"), right.select(*keys, right_id, "c", "d"), keys)
    lists = pairs.groupBy(left_id).agg(F.sort_array(F.collect_list(right_id)).alias("matches"))
    kind = lists.schema["matches"].dataType
    return left.join(lists, left_id, "left").withColumn("matches", F.coalesce("matches", F.array().cast(kind)))
