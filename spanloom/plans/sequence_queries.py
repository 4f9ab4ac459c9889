"""Ordered-row operators over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import sequences as S
from spanloom.sources.tables import micros, read


def session_gap(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select("user_id", "event_id", micros("ts").alias("us"))
    found = S.sessions(e, ["user_id"], "us", ["us", "event_id"], 600_000_000)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def run_collapse(spark: SparkSession, folder: str) -> DataFrame:
    found = S.runs(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def moving_energy(spark: SparkSession, folder: str) -> DataFrame:
    """The first quietest stretch of ten rows for each user, energies rounded so that ties are exact."""
    e = read(spark, folder, "events").select("user_id", "event_id", F.round(F.col("value") * F.col("value"), 4).cast("decimal(28,4)").alias("energy"))
    moved = S.moving_sum(e, ["user_id"], ["event_id"], F.col("energy"), 10)
    return S.first_least(moved, ["user_id"], "moving", "event_id").select("user_id", "event_id", F.col("moving").cast("double").alias("moving"))


def zero_duration_attach(spark: SparkSession, folder: str) -> DataFrame:
    """User turns join the next assistant turn, trailing ones the last."""
    return S.attach(read(spark, folder, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant", "text")


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of assistant turns in the full list of turns."""
    return S.neighbours(read(spark, folder, "conversations"), ["conv_id"], ["turn"], "text").where("role = 'assistant'").select("conv_id", "turn", "previous", "following")


def adjacent_pair_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Turn i with turn i + 1 of the same talk: whether both are filled, and whether they agree."""
    c = read(spark, folder, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = c.withColumn("next_text", F.lead("text").over(w)).withColumn("next_turn", F.lead("turn").over(w))
    return paired.where(F.col("next_turn") == F.col("turn") + 1).select("conv_id", "turn", (F.length(F.trim("text")) > 0).alias("filled"), (F.col("text") == F.col("next_text")).alias("agrees"))


def positional_outer_join(spark: SparkSession, folder: str) -> DataFrame:
    """Channel A (user turns) beside channel B (assistant turns) by position; either may lack a row."""
    c = read(spark, folder, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", F.row_number().over(w).cast("long").alias("i"), F.col("text").alias(name))
    return side("user", "a").join(side("assistant", "b"), ["conv_id", "i"], "full").select("conv_id", "i", "a", "b")


def asof_previous(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value"))
    return S.latest_before(left, right, ["user_id"], "ts", "click_id", "value").select("event_id", "as_of")


def page_total_next(spark: SparkSession, folder: str) -> DataFrame:
    return S.page(read(spark, folder, "events").select("event_id", "user_id", "value"), [F.desc("value"), "event_id"], 40, 20)


def last_page(spark: SparkSession, folder: str) -> DataFrame:
    return S.page(read(spark, folder, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 20, 20).withColumn("next_offset", F.coalesce("next_offset", F.lit(-1).cast("long")))


def latest_revision(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return S.newest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def newest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


def top_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return S.top(read(spark, folder, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), "event_id"], 3).withColumn("rank", F.col("rank").cast("long"))


def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    return S.insert_if_absent(read(spark, folder, "labels"), read(spark, folder, "documents").select("doc_id", "lang"), ["doc_id"])


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as updates over documents' own defaults."""
    base = read(spark, folder, "documents").select("doc_id", F.lit(0).alias("version"), F.lit(-1).alias("quality"))
    update = read(spark, folder, "labels").select("doc_id", F.lit(1).alias("version"), "quality")
    return S.newest(base.unionByName(update), ["doc_id"], ["version"])


def session_window_batch(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    found = e.groupBy("user_id", F.session_window("t", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


QUERIES = {
    "session_gap": session_gap,
    "run_collapse": run_collapse,
    "moving_energy_argmin": moving_energy,
    "zero_duration_attach": zero_duration_attach,
    "neighbours": neighbours,
    "adjacent_pair_compare": adjacent_pair_compare,
    "positional_outer_join": positional_outer_join,
    "asof_previous": asof_previous,
    "page_total_next": page_total_next,
    "last_page": last_page,
    "latest_revision": latest_revision,
    "newest_jobs": newest_jobs,
    "top_per_key": top_per_key,
    "insert_if_absent": insert_if_absent,
    "upsert_latest": upsert_latest,
    "session_window_batch": session_window_batch,
    "tumbling_counts": tumbling_counts,
}

_SESSIONS = """e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 600000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"""

ORACLE_SQL = {
    "session_gap": f"WITH {_SESSIONS} SELECT user_id, session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM n GROUP BY user_id, session",
    "run_collapse": """WITH g AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g)
SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_id FROM n GROUP BY user_id, run, event_type""",
    "moving_energy_argmin": """WITH e AS (SELECT user_id, event_id, CAST(round(value * value, 4) AS DECIMAL(28,4)) AS energy FROM events),
m AS (SELECT user_id, event_id, sum(energy) OVER w AS moving, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, event_id, CAST(moving AS DOUBLE) AS moving FROM m WHERE n = 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY moving, event_id) = 1""",
    "zero_duration_attach": """WITH g AS (SELECT *, greatest(1, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) AS grp FROM conversations)
SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS turn, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, grp HAVING max(CASE WHEN role = 'assistant' THEN turn END) IS NOT NULL""",
    "neighbours": "SELECT conv_id, turn, previous, following FROM (SELECT *, lag(text) OVER w AS previous, lead(text) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'",
    "adjacent_pair_compare": "SELECT a.conv_id, a.turn, length(trim(a.text)) > 0 AS filled, a.text = b.text AS agrees FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "positional_outer_join": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.i, y.i) AS i, x.text AS a, y.text AS b FROM (SELECT * FROM n WHERE role = 'user') x FULL JOIN (SELECT * FROM n WHERE role = 'assistant') y ON x.conv_id = y.conv_id AND x.i = y.i""",
    "asof_previous": """SELECT p.event_id, (SELECT c.value FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS as_of FROM events p WHERE p.event_type = 'purchase'""",
    "page_total_next": "SELECT event_id, user_id, value, (SELECT count(*) FROM events) AS total, CASE WHEN 60 < (SELECT count(*) FROM events) THEN CAST(60 AS BIGINT) END AS next_offset FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40",
    "last_page": "SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS total, CAST(-1 AS BIGINT) AS next_offset FROM nation ORDER BY n_nationkey LIMIT 20 OFFSET 20",
    "latest_revision": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "newest_jobs": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "top_per_key": "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3",
    "insert_if_absent": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "upsert_latest": "SELECT d.doc_id, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version, CAST(CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END AS INTEGER) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "session_window_batch": f"WITH {_SESSIONS}, s AS (SELECT user_id, session, count(*) AS n FROM n GROUP BY user_id, session) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM s GROUP BY user_id",
    "tumbling_counts": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
}
