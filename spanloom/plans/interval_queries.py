"""Interval algebra over ``events`` as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.sources.tables import limits, micros, read, segments

SEG = """seg AS (SELECT * FROM (SELECT user_id % 20 AS rec, user_id % 8 AS speaker, event_id, user_id, event_type,
 epoch_us(ts) // 10000 AS a, epoch_us(ts) // 10000 + 100 * CAST(round_even(value, 0) AS BIGINT) AS b FROM events) WHERE b > a)"""


def _islands(name: str, source: str, keys: str) -> str:
    return f"""{name}_m AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS fresh FROM {source}
 WINDOW w AS (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_n AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
{name} AS (SELECT {keys}, min(a) AS a, max(b) AS b FROM {name}_n GROUP BY {keys}, run)"""


def _difference(name: str, left: str, right: str) -> str:
    return f"""{name}_e AS (SELECT rec, a AS t, 1 AS l, 0 AS r FROM {left} UNION ALL SELECT rec, b, -1, 0 FROM {left}
 UNION ALL SELECT rec, a, 0, 1 FROM {right} UNION ALL SELECT rec, b, 0, -1 FROM {right}),
{name}_t AS (SELECT rec, t, sum(l) AS l, sum(r) AS r FROM {name}_e GROUP BY rec, t),
{name}_s AS (SELECT rec, t AS a, lead(t) OVER w AS b, sum(l) OVER w AS l, sum(r) OVER w AS r FROM {name}_t WINDOW w AS (PARTITION BY rec ORDER BY t)),
{name}_r AS (SELECT rec, a, b FROM {name}_s WHERE l > 0 AND r = 0 AND b IS NOT NULL),
{_islands(name, f"{name}_r", "rec")}"""


_BEST = f"""{SEG}, {_islands("uni", "seg", "rec, speaker")},
tot AS (SELECT rec, speaker, CAST(sum(b - a) AS BIGINT) AS total FROM uni GROUP BY rec, speaker),
best AS (SELECT rec, speaker, total FROM tot QUALIFY row_number() OVER (PARTITION BY rec ORDER BY total DESC, speaker) = 1),
own AS (SELECT rec, a, b FROM uni JOIN best USING (rec, speaker)),
oth AS (SELECT uni.rec, a, b FROM uni JOIN best ON uni.rec = best.rec WHERE uni.speaker <> best.speaker),
{_difference("wall", "oth", "own")}"""


def _regions_sql(gap: int) -> str:
    return f"""WITH {_BEST}, lim AS (SELECT rec, max(b) AS n FROM seg GROUP BY rec),
pad AS (SELECT o.rec, greatest(0, o.a - 20, coalesce((SELECT max(w.b) FROM wall w WHERE w.rec = o.rec AND w.b <= o.a), 0)) AS a,
 least(n, o.b + 20, coalesce((SELECT min(w.a) FROM wall w WHERE w.rec = o.rec AND w.a >= o.b), n)) AS b FROM own o JOIN lim USING (rec)),
{_islands("grown", "pad", "rec")},
gaps AS (SELECT rec, a, b, lag(b) OVER (PARTITION BY rec ORDER BY a) AS last FROM grown),
brk AS (SELECT *, CASE WHEN last IS NULL OR a - last > {gap} OR EXISTS (SELECT 1 FROM wall w WHERE w.rec = gaps.rec AND w.a < gaps.a AND w.b > gaps.last) THEN 1 ELSE 0 END AS fresh FROM gaps),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM brk)
SELECT num.rec, best.speaker, min(a) AS a, max(b) AS b FROM num JOIN best ON num.rec = best.rec GROUP BY num.rec, best.speaker, run"""


def _regions(gap: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        s = segments(spark, folder)
        best, regions = I.dominant_regions(s, limits(s, "rec"), ["rec"], "speaker", gap=gap, block=I.block_for(s, ["rec"]))
        return regions.join(best.select("rec", "speaker"), "rec").select("rec", "speaker", "a", "b")

    return query


def union_duration(spark: SparkSession, folder: str) -> DataFrame:
    s = segments(spark, folder)
    return I.covered(s, ["rec", "speaker"], I.block_for(s, ["rec", "speaker"]))


def union_spans(spark: SparkSession, folder: str) -> DataFrame:
    s = segments(spark, folder)
    return I.islands(s, ["rec", "speaker"], block=I.block_for(s, ["rec", "speaker"])).select("rec", "speaker", "a", "b")


def dominant_key(spark: SparkSession, folder: str) -> DataFrame:
    return I.dominant(union_duration(spark, folder), ["rec"], "speaker")


def others_only(spark: SparkSession, folder: str) -> DataFrame:
    """Where only speakers other than the dominant one are active."""
    s = segments(spark, folder)
    block = I.block_for(s, ["rec"])
    united = I.islands(s, ["rec", "speaker"], block=block)
    totals = united.groupBy("rec", "speaker").agg(F.sum(F.col("b") - F.col("a")).alias("total"))
    both = united.join(I.dominant(totals, ["rec"], "speaker").select("rec", F.col("speaker").alias("best")), "rec")
    return I.difference(both.where("speaker <> best").select("rec", "a", "b"), both.where("speaker = best").select("rec", "a", "b"), ["rec"], block)


def speech_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return union_spans(spark, folder).groupBy("rec").agg(
        F.count("*").alias("n"), F.min(F.col("b") - F.col("a")).alias("least"), F.max(F.col("b") - F.col("a")).alias("most"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean"))


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, folder)
    left = s.where("event_type = 'purchase'").select("user_id", "event_id", "a", "b")
    right = s.where("event_type = 'click'").select("user_id", F.col("event_id").alias("other_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    return left, right


def interval_overlap_count(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _sides(spark, folder)
    return I.overlap_join(left, right, ["user_id"]).groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.least("b", "d") - F.greatest("a", "c")).alias("shared"))


def interval_semi(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _sides(spark, folder)
    return I.overlap_join(left, right, ["user_id"], "left_semi").select("event_id", "a", "b")


def interval_anti(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _sides(spark, folder)
    return I.overlap_join(left, right, ["user_id"], "left_anti").select("event_id", "a", "b")


def interval_left_list(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _sides(spark, folder)
    lists = I.overlap_list(left, right, ["user_id"], "event_id", "other_id")
    return lists.select("event_id", F.size("matches").cast("long").alias("n"), F.array_join(F.col("matches").cast("array<string>"), ",").alias("ids"))


def bucketed_overlap(spark: SparkSession, folder: str) -> DataFrame:
    s = segments(spark, folder).where("event_type = 'purchase'")
    left = s.select("rec", "event_id", "a", "b")
    right = s.select("rec", F.col("event_id").alias("other_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = I.bucketed_overlap_join(left, right, ["rec"], 6000).where("event_id < other_id")
    return pairs.groupBy("rec").agg(F.count("*").alias("pairs"), F.sum(F.least("b", "d") - F.greatest("a", "c")).alias("shared"))


def point_in_interval_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks to the united purchase span that holds them, or the nearest one of their user."""
    own = segments(spark, folder).select("user_id", "event_type", "a", "b")
    block = I.block_for(own, ["user_id"])
    spans = I.islands(own.where("event_type = 'purchase'").select("user_id", "a", "b"), ["user_id"], block=block).withColumn("span", F.col("a"))
    points = read(spark, folder, "events").where("event_type = 'click'").select("user_id", "event_id", F.floor(micros("ts") / 10000).alias("t"))
    return I.locate(points, spans, ["user_id"], "t", "event_id", "span", block).where("span IS NOT NULL").select("event_id", "span", F.col("outside").cast("int").alias("outside"), "distance")


def masked_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of events, zero where another type's span of the same user covers them."""
    walls = segments(spark, folder).where("event_type = 'purchase'").select("user_id", F.col("a").alias("c"), F.col("b").alias("d"))
    points = read(spark, folder, "events").where("event_type = 'click'").select("user_id", "event_id", "value", F.floor(micros("ts") / 10000).alias("a")).withColumn("b", F.col("a") + 1)
    hit = I.overlap_join(points, walls, ["user_id"], "left_semi").select("event_id", F.lit(True).alias("hit"))
    return points.join(hit, "event_id", "left").select("event_id", F.when(F.col("hit"), 0.0).otherwise(F.col("value")).alias("value"))


_SIDES = f"""WITH {SEG}, l AS (SELECT * FROM seg WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS other_id, a AS c, b AS d FROM seg WHERE event_type = 'click')"""

QUERIES = {
    "regions_dominant": _regions(80),
    "regions_dominant_wide_gap": _regions(60000),
    "union_spans": union_spans,
    "union_duration": union_duration,
    "dominant_key": dominant_key,
    "others_only_difference": others_only,
    "speech_length_stats": speech_length_stats,
    "interval_overlap_count": interval_overlap_count,
    "interval_semi": interval_semi,
    "interval_anti": interval_anti,
    "interval_left_list": interval_left_list,
    "bucketed_overlap": bucketed_overlap,
    "point_in_interval_nearest": point_in_interval_nearest,
    "masked_values": masked_values,
}

ORACLE_SQL = {
    "regions_dominant": _regions_sql(80),
    "regions_dominant_wide_gap": _regions_sql(60000),
    "union_spans": f"WITH {SEG}, {_islands('uni', 'seg', 'rec, speaker')} SELECT rec, speaker, a, b FROM uni",
    "union_duration": f"WITH {SEG}, {_islands('uni', 'seg', 'rec, speaker')} SELECT rec, speaker, CAST(sum(b - a) AS BIGINT) AS total FROM uni GROUP BY rec, speaker",
    "dominant_key": f"WITH {_BEST} SELECT rec, speaker, total FROM best",
    "others_only_difference": f"WITH {_BEST} SELECT rec, a, b FROM wall",
    "speech_length_stats": f"WITH {SEG}, {_islands('uni', 'seg', 'rec, speaker')} SELECT rec, count(*) AS n, min(b - a) AS least, max(b - a) AS most, round(avg(b - a), 6) AS mean FROM uni GROUP BY rec",
    "interval_overlap_count": f"{_SIDES} SELECT event_id, count(*) AS n, CAST(sum(least(b, d) - greatest(a, c)) AS BIGINT) AS shared FROM l JOIN r ON l.user_id = r.user_id AND a < d AND c < b GROUP BY event_id",
    "interval_semi": f"{_SIDES} SELECT event_id, a, b FROM l WHERE EXISTS (SELECT 1 FROM r WHERE l.user_id = r.user_id AND a < d AND c < b)",
    "interval_anti": f"{_SIDES} SELECT event_id, a, b FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.user_id = r.user_id AND a < d AND c < b)",
    "interval_left_list": f"{_SIDES} SELECT event_id, count(other_id) AS n, coalesce(string_agg(CAST(other_id AS VARCHAR), ',' ORDER BY other_id), '') AS ids FROM l LEFT JOIN r ON l.user_id = r.user_id AND a < d AND c < b GROUP BY event_id",
    "bucketed_overlap": f"WITH {SEG}, p AS (SELECT * FROM seg WHERE event_type = 'purchase') SELECT x.rec, count(*) AS pairs, CAST(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS shared FROM p x JOIN p y ON x.rec = y.rec AND x.a < y.b AND y.a < x.b AND x.event_id < y.event_id GROUP BY x.rec",
    "point_in_interval_nearest": f"""WITH {SEG}, p AS (SELECT user_id, a, b FROM seg WHERE event_type = 'purchase'), {_islands('uni', 'p', 'user_id')},
pts AS (SELECT user_id, event_id, epoch_us(ts) // 10000 AS t FROM events WHERE event_type = 'click'),
c AS (SELECT event_id, a AS span, CASE WHEN a <= t AND t < b THEN 0 ELSE 1 END AS outside, CASE WHEN a <= t AND t < b THEN 0 ELSE least(abs(t - a), abs(t - b)) END AS distance FROM pts JOIN uni USING (user_id))
SELECT event_id, span, CAST(outside AS INTEGER) AS outside, CAST(distance AS BIGINT) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY outside, distance, span) = 1""",
    "masked_values": f"""WITH {SEG}, w AS (SELECT user_id, a, b FROM seg WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id AND w.a <= epoch_us(e.ts) // 10000 AND epoch_us(e.ts) // 10000 < w.b) THEN 0.0::DOUBLE ELSE value END AS value FROM events e WHERE event_type = 'click'""",
}
