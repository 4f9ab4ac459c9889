"""Review, layout, merging and subtitles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import partitioning as P
from spanloom.operators import reconcile as R
from spanloom.operators import subtitles as T
from spanloom.sources.tables import read

#: Seconds between the starts of a turn's words, their length, and the length of a chunk's core.
PACE, LENGTH, CORE = 0.5, 0.4, 20.0


def chunk_layout_fixed(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "events").groupBy("user_id").agg(F.max("value").alias("seconds"))
    found = P.fixed_layout(d, "seconds")
    rounded = [F.round(c, 6).alias(c) for c in ("start", "end", "core_start", "core_end")]
    return found.select("user_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), *rounded)


def speech_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that overlap a region: events whose value lies near a third of the timeline stand for speech."""
    e = read(spark, folder, "events")
    chunks = P.fixed_layout(e.groupBy("user_id").agg(F.max("value").alias("seconds")), "seconds").select("user_id", "chunk_idx", "core_start", "core_end")
    regions = e.where("event_type = 'purchase'").select("user_id", F.col("value").alias("a"), (F.col("value") + 1).alias("b"))
    return P.speech_chunks(chunks, regions, ["user_id"]).select("user_id", F.col("chunk_idx").cast("int").alias("chunk_idx"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of assistant turns with times: conv_id, i, word, start, end."""
    turns = read(spark, folder, "conversations").where("role = 'assistant'").withColumn("rec", F.col("conv_id") * 1000 + F.col("turn"))
    words = turns.select("rec", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "word"))
    return words.select("rec", "i", "word", (F.col("i") * PACE).alias("start"), (F.col("i") * PACE + LENGTH).alias("end"))


def _aligned(words: DataFrame) -> DataFrame:
    """Each recording in chunks of CORE seconds with one second of context, every chunk with its own copy of the words in its input."""
    seconds = words.groupBy("rec").agg(F.max("end").alias("seconds"))
    chunks = P.fixed_layout(seconds, "seconds", CORE).drop("seconds")
    # A word lies in the core that its start says, or in the context of the one before or after: an equi join, no range.
    near = F.floor(F.col("start") / CORE).cast("int")
    dealt = words.select("rec", "i", "word", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.array(near - 1, near, near + 1)).alias("chunk_idx"))
    hits = dealt.join(chunks, ["rec", "chunk_idx"]).where("s >= start AND e <= end")
    word = F.struct(F.col("i"), F.col("word").alias("text"), (F.col("s") - F.col("start")).alias("start_time"), (F.col("e") - F.col("start")).alias("end_time"))
    chunk = F.struct("start", "end", "core_start", "core_end")
    lists = hits.groupBy("rec", "chunk_idx", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(word)).alias("w"))
    bare = F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time")))
    return lists.select(F.col("rec").alias("rec_id"), "chunk_idx", "chunk", bare.alias("words"))


def seam_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Turns cut into overlapping chunks and merged again: every word comes back once, in order."""
    merged = R.merge_recordings(_aligned(_words(spark, folder)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return merged.groupBy("rec_id").agg(F.count("*").alias("n"), F.array_join(parts, " ").alias("text"))


def srt_render(spark: SparkSession, folder: str) -> DataFrame:
    """Subtitles of turns that pause after every 23rd word and every seventh long word, in two regions with a break between them."""
    w = _words(spark, folder).withColumn("off", 0.9 * F.floor(F.col("i") / 23))
    stretched = F.when((F.length("word") > 8) & (F.col("i") % 7 == 0) & ~F.col("i").between(50, 80), 8.0).otherwise(0.0)
    words = w.select("rec", F.col("i").alias("pos"), (F.col("start") + F.col("off")).alias("start"), (F.col("end") + F.col("off") + stretched).alias("end"), F.col("word").alias("text"))
    spans = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(31.3).alias("b")), F.struct(F.lit(33.0).alias("a"), F.lit(10_000.0).alias("b")))
    regions = words.select("rec").distinct().select("rec", F.explode(spans).alias("s")).select("rec", "s.a", "s.b")
    return T.render(words, regions, ["rec"])


def subtitle_words(spark: SparkSession, folder: str) -> DataFrame:
    """How many words a cue's time leaves: those whose middle lies in the first 30 seconds, clipped there."""
    w = _words(spark, folder).where("(start + end) / 2 < 30")
    return w.groupBy("rec").agg(F.count("*").alias("n"), F.round(F.max(F.least("end", F.lit(30.0))), 6).alias("last"))


def history_of_page(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of orders with any line on a page of parts, and just those of their changes."""
    page = read(spark, folder, "part").orderBy("p_partkey").offset(10).limit(20).select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, folder, "lineitem").join(page, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


def invalid_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of decisions as rows against stored segments: every violation is a row, and a batch without rows may be committed."""
    c = read(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "A").otherwise("edited").alias("choice"))
    known = read(spark, folder, "documents").select("doc_id", F.length(F.trim("text")).alias("len"))
    w = Window.partitionBy("doc_id")
    joined = c.withColumn("copies", F.count(F.lit(1)).over(w)).join(known, "doc_id", "left")
    rules = F.array(
        F.when(F.col("len").isNull(), F.lit("unknown segment")),
        F.when(F.col("copies") > 1, F.lit("duplicate")),
        F.when((F.col("choice") == "edited") & (F.col("len") < 400), F.lit("edited text too short")),
        F.when(F.col("choice") == "uncertain", F.lit("question required")),
    )
    return joined.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("violation"))


QUERIES = {f.__name__: f for f in (chunk_layout_fixed, speech_chunks, seam_merge, srt_render, subtitle_words, history_of_page, invalid_decisions)}

_STAMP = "printf('%02d:%02d:%02d,%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"
_D = "d AS (SELECT user_id, max(value) AS seconds FROM events GROUP BY user_id HAVING max(value) > 0), c AS (SELECT user_id, seconds, CAST(unnest(range(0, greatest(1, CAST(ceil(seconds / 18) AS BIGINT)))) AS INTEGER) AS chunk_idx FROM d)"
_W = r"t AS (SELECT conv_id * 1000 + turn AS rec, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant')"

#: Cues word by word: the state of a recording is the present cue's number, beginning and characters, and the word before.
_SRT = f"""WITH RECURSIVE {_W}, x AS (SELECT rec, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t),
y AS (SELECT rec, i, word, (i * 500000 + i // 23 * 900000)::BIGINT AS s, (i * 500000 + 400000 + i // 23 * 900000 + CASE WHEN length(word) > 8 AND i % 7 = 0 AND i NOT BETWEEN 50 AND 80 THEN 8000000 ELSE 0 END)::BIGINT AS e FROM x),
r AS (SELECT *, CASE WHEN s + e < 62600000 THEN 0 WHEN s + e >= 66000000 THEN 1 END AS region FROM y),
k AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s, e, i) AS j, word, greatest(s, region * 33000000) AS s, CASE WHEN region = 0 THEN least(e, 31300000) ELSE e END AS e, region FROM r WHERE region IS NOT NULL AND CASE WHEN region = 0 THEN least(e, 31300000) ELSE e END > greatest(s, region * 33000000)),
g(rec, j, n, s0, chars, e, region, closed) AS (SELECT rec, j, 1, s, length(word), e, region, regexp_matches(word, '[.!?…]["»)]?$') FROM k WHERE j = 1
UNION ALL SELECT rec, j, CASE WHEN new THEN n + 1 ELSE n END, CASE WHEN new THEN s ELSE s0 END, CASE WHEN new THEN length(word) ELSE chars + 1 + length(word) END, e, region, closed
FROM (SELECT k.rec, k.j, g.n, g.s0, g.chars, k.s, k.e, k.region, k.word, regexp_matches(k.word, '[.!?…]["»)]?$') AS closed, g.closed OR k.region <> g.region OR k.s - g.e > 800000 OR k.e - g.s0 > 7000000 OR g.chars + 1 + length(k.word) > 84 AS new FROM g JOIN k ON k.rec = g.rec AND k.j = g.j + 1)),
c AS (SELECT rec, n, min(k.s) AS s, arg_max(k.e, j) AS e, list(word ORDER BY j) AS w FROM g JOIN k USING (rec, j) GROUP BY rec, n),
d AS (SELECT *, least(e, s + 7000000, coalesce(lead(s) OVER (PARTITION BY rec ORDER BY n), e)) AS f, list_reduce(w, lambda a, b: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(b) <= 42 THEN a || ' ' || b ELSE a || chr(10) || b END) AS lines FROM c),
m AS (SELECT *, CAST(round_even(s / 1000.0, 0) AS BIGINT) AS ms, CAST(round_even(f / 1000.0, 0) AS BIGINT) AS mf,
list_min(list_transform(range(1, len(w)), lambda q: {{'u': abs(length(array_to_string(w[1:q], ' ')) - length(array_to_string(w[q + 1:], ' '))), 'q': q}})).q AS cut FROM d)
SELECT rec, string_agg(n || chr(10) || {_STAMP.format('ms')} || ' --> ' || {_STAMP.format('mf')} || chr(10) || CASE WHEN len(string_split(lines, chr(10))) <= 2 THEN lines ELSE array_to_string(w[1:cut], ' ') || chr(10) || array_to_string(w[cut + 1:], ' ') END, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM m GROUP BY rec"""

ORACLE_SQL = {
    "srt_render": _SRT,
    "chunk_layout_fixed": f"WITH {_D} SELECT user_id, chunk_idx, round(greatest(0.0::DOUBLE, chunk_idx * 18.0::DOUBLE - 1), 6) AS start, round(least(seconds, least(seconds, (chunk_idx + 1) * 18.0::DOUBLE) + 1), 6) AS \"end\", round(chunk_idx * 18.0::DOUBLE, 6) AS core_start, round(least(seconds, (chunk_idx + 1) * 18.0::DOUBLE), 6) AS core_end FROM c",
    "speech_chunks": f"WITH {_D} SELECT user_id, chunk_idx FROM c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND event_type = 'purchase' AND e.value < least(seconds, (chunk_idx + 1) * 18.0::DOUBLE) AND e.value + 1 > chunk_idx * 18.0::DOUBLE)",
    "seam_merge": f"WITH {_W} SELECT rec AS rec_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w, ' ') AS text FROM t WHERE len(w) > 0",
    "subtitle_words": f"WITH {_W}, x AS (SELECT rec, unnest(range(0, len(w))) AS i FROM t) SELECT rec, count(*) AS n, round(max(least(i * 0.5::DOUBLE + 0.4::DOUBLE, 30.0::DOUBLE)), 6) AS last FROM x WHERE i * 0.5::DOUBLE + 0.2::DOUBLE < 30 GROUP BY rec",
    "history_of_page": "WITH p AS (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20 OFFSET 10), l AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM p)) SELECT l_orderkey, count(*) AS n, (SELECT string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) FROM (SELECT DISTINCT l_partkey AS q FROM l k WHERE k.l_orderkey = l.l_orderkey)) AS parts FROM l GROUP BY l_orderkey",
    "invalid_decisions": """WITH c AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'A' ELSE 'edited' END AS choice, count(*) OVER (PARTITION BY l.doc_id) AS copies, length(trim(text)) AS len FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id, 'unknown segment' AS violation FROM c WHERE len IS NULL UNION ALL SELECT doc_id, 'duplicate' FROM c WHERE copies > 1 UNION ALL SELECT doc_id, 'edited text too short' FROM c WHERE choice = 'edited' AND len < 400 UNION ALL SELECT doc_id, 'question required' FROM c WHERE choice = 'uncertain'""",
}
