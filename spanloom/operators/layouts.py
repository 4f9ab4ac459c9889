"""Layouts over rows of 10 ms frames: recordings of any length, cut where they are quietest, without a recording in one task.

Times are whole frames. A window is ``WINDOW`` frames; a cut stands in the middle of the first window of least energy in the range
that the cut before leaves. Each cut depends on the one before, but on nothing else, so the cut that would follow can be found for every
place at once; the cuts that do follow are then a chain (``plans/chains``).

* Over ranges of one length that is a range minimum by doubling: the least of 2, 4, 8, ... windows from each frame on, and two of the
  longest that fit cover the range. Frames are dealt to blocks of a recording, each with the first frames of the next one.
* Where limits from both ends shorten the ranges, as in ``packed_chunks``, the few places that any cut can stand at are found first:
  least windows of all ranges of full length, and the running least ones from each limit. Ranges are looked up for these alone.

Energies are compared as decimals of ``DIGITS`` digits, so that equal windows are ties, of which the first counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import bucketed_overlap_join
from spanloom.operators.partitioning import CONTEXT
from spanloom.plans.chains import reached
from spanloom.plans.scratch import materialise, release

#: Frames a second, frames of a window, digits of energies.
RATE, WINDOW, DIGITS = 100, 10, 9
#: Frames of a block: an hour.
BLOCK = 360_000

Keys = Sequence[str]


def _frames(seconds: float) -> int:
    n = round(seconds * RATE)
    if abs(n / RATE - seconds) > 1e-9:
        raise ValueError("limits are whole frames of 10 ms")
    return n


def _blocks(frames: DataFrame, keys: Keys, ahead: int, block: int) -> DataFrame:
    """Frames by ``_block``, each block with ``ahead`` frames of the next ones, which have ``_own`` false."""
    if ahead > block:
        raise ValueError("a block must be longer than the farthest range")
    at = F.floor(F.col("frame") / block).cast("long")
    first = F.when(F.col("frame") % block < ahead, at - 1).otherwise(at)
    return frames.select(*keys, "frame", "energy", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), at)).alias("_block")).withColumn("_own", F.col("_block") == at)


def _moving(w) -> Column:
    """Energy and place of the window that begins at each frame; null where the frames end before it does."""
    ahead = w.rowsBetween(0, WINDOW - 1)
    total = F.sum(F.round("energy", DIGITS).cast("decimal(28,9)")).over(ahead)
    return F.when(F.count(F.lit(1)).over(ahead) == WINDOW, F.struct(total.alias("energy"), F.col("frame").alias("frame")))


def windows(frames: DataFrame, keys: Keys, block: int = BLOCK) -> DataFrame:
    """keys, frame and ``window`` (energy, frame) of every whole window. Frames: keys, frame, energy, without gaps."""
    w = Window.partitionBy(*keys, "_block").orderBy("frame")
    dealt = _blocks(frames, keys, WINDOW, block).withColumn("window", _moving(w))
    return dealt.where("_own AND window IS NOT NULL").select(*keys, "frame", "window")


def next_cuts(frames: DataFrame, keys: Keys, low: int, high: int, block: int = BLOCK) -> DataFrame:
    """keys, frame and ``cut``: the middle of the first least window in [frame + low, frame + high), for every frame that has one."""
    count = high - low - WINDOW + 1
    if count < 1:
        raise ValueError("no window fits the range")
    w = Window.partitionBy(*keys, "_block").orderBy("frame")
    rows = _blocks(frames, keys, high, block).withColumn("_m", _moving(w))
    levels = floor(log2(count))
    for k in range(levels):
        rows = rows.withColumn("_m", F.least("_m", F.lead("_m", 2**k).over(w)))
    found = F.least(F.lead("_m", low).over(w), F.lead("_m", low + count - 2**levels).over(w))
    return rows.withColumn("_found", found).where("_own AND _found IS NOT NULL").select(*keys, "frame", (F.col("_found.frame") + WINDOW // 2).alias("cut"))


def range_cuts(queries: DataFrame, own_windows: DataFrame, keys: Keys, names: Sequence[str]) -> DataFrame:
    """keys, ``names`` and ``cut``: the middle of the first least window in [low, high) of each query; its rows meet as many windows as it has frames."""
    places = F.explode(F.sequence("low", F.col("high") - WINDOW)).alias("frame")
    wanted = queries.where(F.col("high") - F.col("low") > WINDOW).select(*keys, *names, places)
    met = wanted.join(own_windows, [*keys, "frame"])
    return met.groupBy(*keys, *names).agg(F.min("window").alias("_w")).select(*keys, *names, (F.col("_w.frame") + WINDOW // 2).alias("cut"))


def _chunks(cuts: DataFrame, keys: Keys, low: Column, high: Column) -> DataFrame:
    """Chunks from rows of (keys, region, at, ...): cores from each cut to the next or to ``high``, inputs with context in [low, high]."""
    w = Window.partitionBy(*keys, "region").orderBy("at")  # one row a core
    rows = cuts.withColumn("core_start", F.col("at") / RATE).withColumn("core_end", F.coalesce(F.lead("at").over(w), high) / RATE)
    rows = rows.where("core_end > core_start").withColumn("chunk_idx", (F.row_number().over(w) - 1).cast("int"))
    start, end = F.greatest(low / RATE, F.col("core_start") - CONTEXT), F.least(high / RATE, F.col("core_end") + CONTEXT)
    return rows.select(*keys, "region", "chunk_idx", start.alias("start"), end.alias("end"), "core_start", "core_end")


def _chained(table: DataFrame, starts: DataFrame, keys: Keys, most: int) -> DataFrame:
    """The cuts of each region, its start among them, from ``next_cuts``: the chain goes on while more than ``most`` frames are left."""
    table = materialise(table, "cuts")
    nodes = table.select(*keys, F.col("cut").alias("frame")).union(starts.select(*keys, F.col("at").alias("frame"))).distinct()
    jumps = materialise(table.join(nodes, [*keys, "frame"]).select(*keys, F.col("frame").alias("at"), F.col("cut").alias("to")), "jumps")
    release(table)
    found = reached(starts, jumps, keys, "at", "to", "at < b")
    release(jumps)
    before = F.lag("at").over(Window.partitionBy(*keys, "region").orderBy("at"))
    return found.withColumn("_before", before).where((F.col("at") == F.col("a")) | (F.col("b") - F.col("_before") > most)).drop("_before")


def region_chunks(frames: DataFrame, regions: DataFrame, keys: Keys, most: float = 28.0, search: float = 8.0, block: int = BLOCK) -> DataFrame:
    """keys, region (its first frame), chunk_idx and bounds in seconds: each region by itself, in cores of at most ``most`` seconds.

    Regions: keys, a, b in frames. A cut is sought in the last ``search`` seconds, or the last half if that is shorter, of what a core may take.
    """
    reach = _frames(most)
    if reach < 4 * WINDOW:
        raise ValueError("the greatest core must be longer")
    starts = regions.where("b > a").select(*keys, F.col("a").alias("at"), F.col("a").alias("region"), "a", "b")
    cuts = _chained(next_cuts(frames, keys, reach - min(_frames(search), reach // 2), reach, block), starts, keys, reach)
    return _chunks(cuts, keys, F.col("a"), F.col("b"))


def spoken(chunks: DataFrame, speech: DataFrame, keys: Keys, bucket: int = 60 * RATE) -> DataFrame:
    """The chunks whose cores share time with speech (keys, a, b in frames), by buckets of a minute."""
    low, high = F.floor(F.col("core_start") * RATE).cast("long"), F.ceil(F.col("core_end") * RATE).cast("long")
    left = chunks.select(*keys, "region", "chunk_idx", "core_start", "core_end", low.alias("a"), high.alias("b"))
    pairs = bucketed_overlap_join(left, speech.select(*keys, F.col("a").alias("c"), F.col("b").alias("d")), keys, bucket)
    exact = pairs.where((F.col("c") / RATE < F.col("core_end")) & (F.col("d") / RATE > F.col("core_start")))
    return chunks.join(exact.select(*keys, "region", "chunk_idx").distinct(), [*keys, "region", "chunk_idx"], "left_semi")


def sliding_chunks(frames: DataFrame, limits: DataFrame, speech: DataFrame, keys: Keys, most: float = 18.0, search: float = 4.0, block: int = BLOCK) -> DataFrame:
    """Whole timelines (keys, n in frames) in cores of at most ``most`` seconds; only those with speech, by their numbers among all."""
    reach = _frames(most)
    starts = limits.where("n > 0").select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("region"), F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    cuts = _chained(next_cuts(frames, keys, max(RATE, reach - _frames(search)), reach, block), starts, keys, reach)
    return spoken(_chunks(cuts, keys, F.col("a"), F.col("b")), speech, keys)


def packing(limits: DataFrame, least: float = 60, most: float = 118) -> DataFrame:
    """``limits`` (keys, n in frames) with ``cores``, the fewest that hold n, and ``size``, n padded so that each has ``least`` seconds."""
    low, high = ceil(round(least * RATE, 6)), floor(round(most * RATE, 6))
    if not 1 <= low <= high:
        raise ValueError("no whole number of frames lies between the limits")
    cores = F.greatest(F.lit(1), F.ceil(F.col("n") / high)).cast("long")
    return limits.withColumn("cores", cores).withColumn("size", F.greatest(F.col("n").cast("long"), F.col("cores") * low))


def _bounds(at: Column, k: Column, least: int, most: int, search: int) -> tuple[Column, Column]:
    """Where the cut after the k-th, which stands at ``at``, may be: the limits of its core, of all cores before and of all after, and the search."""
    left = F.col("cores") - k - 1
    high = F.least(at + most, F.col("size") - left * least)
    return F.greatest(at + least, F.col("size") - left * most, high - search), high


def packed_chunks(frames: DataFrame, limits: DataFrame, speech: DataFrame, keys: Keys, least: float = 60, most: float = 118, search: float = 8.0, block: int = BLOCK) -> DataFrame:
    """Padded timelines (keys, n in frames) in as few cores as the limits allow; only those with speech, by their numbers among all.

    As many cores as are needed leave less than one core of room to spare, so the k-th cut stands in the last of that room before k times
    the greatest core: places of different cuts are apart, and a place tells its k. What is padded is silent. Recordings are whole frames.
    """
    low, high, reach = _frames(least), _frames(most), _frames(search)
    if reach <= WINDOW:
        raise ValueError("the search must be longer than a window")
    sizes = materialise(packing(limits, least, most), "sizes")
    silence = sizes.where("size > n").select(*keys, F.explode(F.sequence("n", F.col("size") - 1)).alias("frame"), F.lit(0.0).alias("energy"))
    padded = frames.select(*keys, "frame", F.col("energy").cast("double").alias("energy")).unionByName(silence)
    own = materialise(windows(padded, keys, block), "windows")
    cut = (F.col("window.frame") + WINDOW // 2).alias("at")
    # Least windows of ranges of full length, wherever they are, and from each limit on, as far as a search goes.
    full = min(reach, high - low)
    places = next_cuts(padded, keys, 0, full, block).select(*keys, F.col("cut").alias("at")) if full > WINDOW else own.where("false").select(*keys, cut)
    limit = F.explode(F.sequence(F.lit(1).cast("long"), F.col("cores") - 1))
    inner = sizes.where("cores > 1").select(*keys, "cores", "size", limit.alias("k"))
    for bound, at, frame in ((F.col("size") - (F.col("cores") - F.col("k")) * high, F.asc, 1), (F.col("size") - (F.col("cores") - F.col("k")) * low, F.desc, -1)):
        edge = inner.withColumn("_edge", bound)
        near = F.sequence("_edge", F.col("_edge") + reach) if frame > 0 else F.sequence(F.col("_edge") - reach, "_edge")
        rows = edge.select(*keys, "k", F.explode(near).alias("frame")).join(own, [*keys, "frame"])
        w = Window.partitionBy(*keys, "k").orderBy(at("frame")).rowsBetween(Window.unboundedPreceding, 0)  # a search's frames
        places = places.union(rows.select(*keys, F.min("window").over(w).alias("window")).select(*keys, cut))
    # A place tells its cut; beyond what any cut may take, it is none.
    k = F.ceil(F.col("at") / high).cast("long")
    nodes = places.distinct().join(sizes, list(keys)).withColumn("k", k).where("k < cores")
    nodes = nodes.unionByName(sizes.select(*keys, F.lit(0).cast("long").alias("at"), "n", "cores", "size", F.lit(0).cast("long").alias("k")))
    first, last = _bounds(F.col("at"), F.col("k"), low, high, reach)
    asked = materialise(nodes.where("k + 1 < cores").select(*keys, "at", "k", first.alias("low"), last.alias("high")).where("low <= high"), "asked")
    jumps = materialise(range_cuts(asked, own, keys, ["at"]).withColumnRenamed("cut", "to"), "jumps")
    starts = sizes.select(*keys, F.lit(0).cast("long").alias("at"), "cores", "size")
    found = reached(starts, jumps, keys, "at", "to", "at < size").withColumn("k", F.ceil(F.col("at") / high).cast("long"))
    # Where the range is no longer than a window, its middle is the cut, and that of all cuts after: they are worked out by samples.
    unit = 160
    stuck = found.join(jumps.select(*keys, "at"), [*keys, "at"], "left_anti").where("k + 1 < cores")

    def halfway(at: Column, k: Column) -> Column:
        left = F.col("cores") - k - 1
        top = F.least(at + high * unit, (F.col("size") - left * low) * unit)
        bottom = F.greatest(at + low * unit, (F.col("size") - left * high) * unit, top - reach * unit)
        return F.rint((bottom + top) / 2).cast("long")

    step = lambda places, k: F.concat(places, F.array(halfway(F.element_at(places, -1), k)))
    rest = F.aggregate(F.sequence("k", F.col("cores") - 2), F.array(F.col("at") * unit), step)
    middles = stuck.select(*keys, "size", F.explode(F.slice(rest, 2, F.size(rest))).alias("_at")).select(*keys, (F.col("_at") / unit).alias("at"), "size")
    cuts = found.select(*keys, F.col("at").cast("double").alias("at"), "size").unionByName(middles).withColumn("region", F.lit(0).cast("long"))
    return spoken(_chunks(cuts, keys, F.lit(0.0), F.col("size").cast("double")), speech, keys)


def split_chunks(frames: DataFrame, chunks: DataFrame, keys: Keys, least: float = 1.0, zone: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Each chunk (keys, chunk_idx, and bounds in seconds on whole frames) in two, cut at the quietest place near the middle of its core.

    keys, chunk_idx, part (0 or 1) and bounds; raises an error for a core too short to be cut.
    """
    length = F.col("core_end") - F.col("core_start")
    checked = F.when(length < 2 * max(least, 1.0), F.raise_error(F.lit("the chunk is too short to be cut in two"))).when(length == 2, F.raise_error(F.lit("the chunk is too short to be cut in two"))).otherwise(F.lit(None).cast("string"))
    middle = (F.col("core_start") + F.col("core_end")) / 2
    reach = F.least(F.lit(zone), length / 2 - least)
    rows = chunks.where(checked.isNull()).select("*", F.rint((middle - reach) * RATE).cast("long").alias("low"), F.rint((middle + reach) * RATE).cast("long").alias("high"))
    found = range_cuts(rows, windows(frames, keys, block), keys, ["chunk_idx"])
    both = rows.join(found, [*keys, "chunk_idx"], "left").withColumn("_cut", F.coalesce(F.col("cut") / RATE, (F.col("low") + F.col("high")) / 2 / RATE))
    cut = F.col("_cut")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("start").alias("start"), F.least("end", cut + CONTEXT).alias("end"), F.col("core_start").alias("core_start"), cut.alias("core_end")),
        F.struct(F.lit(1).alias("part"), F.greatest("start", cut - CONTEXT).alias("start"), F.col("end").alias("end"), cut.alias("core_start"), F.col("core_end").alias("core_end")),
    )
    return both.select(*keys, "chunk_idx", F.explode(parts).alias("p")).select(*keys, "chunk_idx", "p.*")


def silenced(frames: DataFrame, excluded: DataFrame, keys: Keys, bucket: int = 60 * RATE) -> DataFrame:
    """Frames with ``energy`` 0 where an excluded span (keys, a, b in frames) covers them; all others, and all rows, stay."""
    left = frames.select(*keys, "frame", "energy", F.col("frame").alias("a"), (F.col("frame") + 1).alias("b"))
    hit = bucketed_overlap_join(left.select(*keys, "frame", "a", "b"), excluded.select(*keys, F.col("a").alias("c"), F.col("b").alias("d")), keys, bucket).select(*keys, "frame").distinct()
    return frames.join(hit.withColumn("_hit", F.lit(True)), [*keys, "frame"], "left").withColumn("energy", F.when(F.col("_hit"), F.lit(0).cast(frames.schema["energy"].dataType)).otherwise(F.col("energy"))).drop("_hit")
