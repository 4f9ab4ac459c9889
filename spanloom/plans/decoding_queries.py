"""Scores and decoding over ``embeddings`` as log-probability rows, and confidence over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import decoding as D
from spanloom.operators import sequences as S
from spanloom.sources.tables import read


def softmax_entropy(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", D.softmax(F.col("v")).alias("p")).select("vec_id", F.round(D.entropy_confidence(F.col("p")), 6).alias("confidence"), (F.array_position("p", F.array_max("p")) - 1).alias("best"))


def log_sum_exp(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select("vec_id", F.round(D.log_sum_exp(F.col("embedding").cast("array<double>")), 6).alias("lse"))


def two_level_confidence(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").withColumn("word", F.floor(F.col("event_id") / 7))
    found = D.two_level_confidence(e, ["user_id"], "word", "value")
    return found.select("user_id", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


def greedy_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Likeliest of 8 symbols in each frame; runs collapse, and blanks (symbol 0) separate them."""
    e = read(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("v"))
    best = e.select(F.floor(F.col("vec_id") / 20).alias("chunk"), "vec_id", (F.array_position("v", F.array_max("v")) - 1).alias("token"))
    found = S.runs(best, ["chunk"], ["vec_id"], "token").where("token <> 0")
    one = found.groupBy("chunk", "run", "token").agg(F.count("*").alias("frames"))
    w = Window.partitionBy("chunk").orderBy("run")
    return one.select("chunk", F.row_number().over(w).cast("long").alias("place"), "token", "frames")


def _log_softmax(vector, scale: float):
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    return D.bound(scaled, lambda v: D.bound(D.log_sum_exp(v), lambda lse: F.transform(v, lambda x: x - lse)))


def ctc_beam(spark: SparkSession, folder: str) -> DataFrame:
    """Beam decoding, eight wide, of chunks of 20 frames over 6 symbols."""
    frames = read(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("chunk"), F.col("vec_id").alias("t"), _log_softmax(F.slice("embedding", 1, 6), 8.0).alias("lp"))
    return D.decode_chunks(frames, ["chunk"], 0, 8).select("chunk", F.size("tokens").cast("long").alias("n"), F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


#: Symbols of the short chunks, and the terms that they are biased to.
SPELLING = D.Spelling(("", "a", "b", " "), ("a", "ba", "bb"), 0.75)


def ctc_bias(spark: SparkSession, folder: str) -> DataFrame:
    """The best text of each vector, read as 16 frames' scores of 4 symbols of which 6 frames are decoded, by all its paths and a bonus for terms."""
    v = read(spark, folder, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t"), "embedding")
    frames = v.select("vec_id", "t", _log_softmax(F.slice("embedding", F.col("t") * 4 + 1, F.lit(4)), 6.0).alias("lp"))
    found = D.decode_chunks(frames, ["vec_id"], 0, 10_000, SPELLING)
    return found.select("vec_id", F.array_join(F.col("tokens").cast("array<string>"), "").alias("tokens"))


def transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as a table of scores: 3 frames, 4 states, 4 symbols; the best text by all its alignments and a bonus for terms, the frames that were cut off, and the greedy text."""
    v = read(spark, folder, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "embedding")
    scores = v.select("vec_id", F.expr("i div 4").alias("t"), (F.col("i") % 4).alias("state"), _log_softmax(F.slice("embedding", F.col("i") * 4 + 1, F.lit(4)), 6.0).alias("lp"))
    found = D.transduce_chunks(scores, ["vec_id"], 0, 10_000, 2, spelling=SPELLING)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "").alias(c)
    return found.select("vec_id", text("tokens"), "hits", text("greedy"))


def transducer_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same without terms, where each text grows by its likeliest symbol alone."""
    v = read(spark, folder, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "embedding")
    scores = v.select("vec_id", F.expr("i div 4").alias("t"), (F.col("i") % 4).alias("state"), _log_softmax(F.slice("embedding", F.col("i") * 4 + 1, F.lit(4)), 6.0).alias("lp"))
    found = D.transduce_chunks(scores, ["vec_id"], 0, 10_000, 2, topk=1)
    return found.select("vec_id", F.array_join(F.col("tokens").cast("array<string>"), "").alias("tokens"), "hits")


def chunk_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of users by the words (sevens of events) of their purchases; null for a user without a purchase."""
    e = read(spark, folder, "events")
    frames = e.withColumn("word", F.when(F.col("event_type") == "purchase", F.expr("event_id div 7"))).where("value > 100 OR word IS NULL")
    found = D.chunk_confidence(e.select("user_id").distinct(), frames, ["user_id"], "word", "value")
    return found.select("user_id", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (softmax_entropy, log_sum_exp, two_level_confidence, greedy_collapse, ctc_beam, ctc_bias, transducer, transducer_topk, chunk_confidence)}

#: Probabilities of a vector's groups of four, the bonus of a text whose words stand for terms, and the sum over the ways to a text.
_FOURS = "e AS (SELECT vec_id, i, list_transform(CAST(embedding[i * 4 + 1:i * 4 + 4] AS DOUBLE[]), lambda x: x * 6) AS v FROM embeddings, range({0}) AS r(i)), p AS (SELECT vec_id, i, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p FROM e)"
_BONUS = "0.75::DOUBLE * len(list_filter(string_split(translate(prefix, '123', 'ab '), ' '), lambda w: w IN ('a', 'ba', 'bb')))"
_TRANSDUCER = """r(vec_id, t, n, prefix, m) AS (SELECT DISTINCT vec_id, 0, 0, '', 1.0::DOUBLE FROM p UNION ALL
SELECT vec_id, s.t, s.n, s.prefix, s.m FROM (SELECT r.vec_id, unnest(list_filter([{{'t': t + 1, 'n': 0, 'prefix': prefix, 'm': m * p.p[1]}}] || list_transform({0}, lambda k: {{'t': t, 'n': n + 1, 'prefix': prefix || k, 'm': m * p.p[k + 1]}}), lambda x: x.n <= 2)) AS s
FROM r JOIN p ON p.vec_id = r.vec_id AND p.i = r.t * 4 + CASE WHEN prefix = '' THEN 0 ELSE CAST(right(prefix, 1) AS INTEGER) END)),
h AS (SELECT vec_id, count(*) AS hits FROM (SELECT DISTINCT vec_id, t, prefix FROM r WHERE n = 2) d JOIN p USING (vec_id) WHERE p.i = d.t * 4 + CAST(right(prefix, 1) AS INTEGER) AND list_position(p.p, list_max(p.p)) <> 1 GROUP BY vec_id)"""
_LIKELIEST = "[CAST(CASE WHEN p.p[2] >= p.p[3] AND p.p[2] >= p.p[4] THEN 1 WHEN p.p[3] >= p.p[4] THEN 2 ELSE 3 END AS BIGINT)]"

ORACLE_SQL = {
    "ctc_beam": """WITH RECURSIVE e AS (SELECT vec_id // 20 AS chunk, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS t, list_transform(CAST(embedding[1:6] AS DOUBLE[]), lambda x: x * 8) AS v FROM embeddings),
p AS (SELECT chunk, t, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p FROM e),
r(chunk, t, prefix, b, n) AS (SELECT DISTINCT chunk, 0::BIGINT, CAST([] AS BIGINT[]), 1.0::DOUBLE, 0.0::DOUBLE FROM p UNION ALL
SELECT chunk, t, prefix, b, n FROM (SELECT chunk, t, s.prefix AS prefix, sum(s.b) AS b, sum(s.n) AS n, row_number() OVER (PARTITION BY chunk ORDER BY sum(s.b) + sum(s.n) DESC, s.prefix) AS rank
FROM (SELECT r.chunk, r.t + 1 AS t, unnest([{'prefix': prefix, 'b': (b + n) * p.p[1], 'n': CASE WHEN len(prefix) > 0 THEN n * p.p[prefix[-1] + 1] ELSE 0.0::DOUBLE END}] || list_transform(range(1, 6), lambda k: {'prefix': prefix || [k], 'b': 0.0::DOUBLE, 'n': CASE WHEN len(prefix) > 0 AND prefix[-1] = k THEN b ELSE b + n END * p.p[k + 1]})) AS s
FROM r JOIN p ON p.chunk = r.chunk AND p.t = r.t) GROUP BY chunk, t, s.prefix) WHERE rank <= 8),
z AS (SELECT chunk, arg_min(prefix, {'m': -(b + n), 'prefix': prefix}) AS prefix FROM r JOIN (SELECT chunk, max(t) + 1 AS t FROM p GROUP BY chunk) USING (chunk, t) GROUP BY chunk)
SELECT chunk, CAST(len(prefix) AS BIGINT) AS n, array_to_string(prefix, ' ') AS tokens FROM z""",
    "ctc_bias": f"""WITH RECURSIVE {_FOURS.format(6)}, r(vec_id, t, prefix, last, m) AS (SELECT DISTINCT vec_id, 0, '', 0::BIGINT, 1.0::DOUBLE FROM p UNION ALL
SELECT r.vec_id, r.t + 1, CASE WHEN k = 0 OR k = last THEN prefix ELSE prefix || k END, k, m * p.p[k + 1] FROM r JOIN p ON p.vec_id = r.vec_id AND p.i = r.t CROSS JOIN range(4) AS q(k)),
g AS (SELECT vec_id, prefix, ln(sum(m)) AS m FROM r WHERE t = 6 GROUP BY vec_id, prefix)
SELECT vec_id, arg_min(prefix, {{'m': -(m + {_BONUS}), 'prefix': prefix}}) AS tokens FROM g GROUP BY vec_id""",
    "transducer": f"""WITH RECURSIVE {_FOURS.format(12)}, {_TRANSDUCER.format("range(1, 4)")},
g AS (SELECT vec_id, prefix, ln(sum(m)) AS m FROM r WHERE t = 3 GROUP BY vec_id, prefix), z AS (SELECT vec_id, arg_min(prefix, {{'m': -(m + {_BONUS}), 'prefix': prefix}}) AS tokens FROM g GROUP BY vec_id),
a AS (SELECT vec_id, i, list_position(p, list_max(p)) - 1 AS best FROM p), y(vec_id, t, n, prefix) AS (SELECT DISTINCT vec_id, 0, 0, '' FROM p UNION ALL
SELECT y.vec_id, CASE WHEN best = 0 OR n = 1 THEN t + 1 ELSE t END, CASE WHEN best = 0 OR n = 1 THEN 0 ELSE n + 1 END, CASE WHEN best = 0 THEN prefix ELSE prefix || best END FROM y JOIN a ON a.vec_id = y.vec_id AND a.i = y.t * 4 + CASE WHEN prefix = '' THEN 0 ELSE CAST(right(prefix, 1) AS INTEGER) END)
SELECT vec_id, tokens, CAST(coalesce(hits, 0) AS INTEGER) AS hits, prefix AS greedy FROM z JOIN y USING (vec_id) LEFT JOIN h USING (vec_id) WHERE y.t = 3""",
    "transducer_topk": f"""WITH RECURSIVE {_FOURS.format(12)}, {_TRANSDUCER.format(_LIKELIEST)},
g AS (SELECT vec_id, prefix, ln(sum(m)) AS m FROM r WHERE t = 3 GROUP BY vec_id, prefix)
SELECT vec_id, arg_min(prefix, {{'m': -m, 'prefix': prefix}}) AS tokens, CAST(coalesce(any_value(hits), 0) AS INTEGER) AS hits FROM g LEFT JOIN h USING (vec_id) GROUP BY vec_id""",
    "chunk_confidence": """WITH w AS (SELECT user_id, event_id // 7 AS word, min(value) AS v FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY ALL)
SELECT u.user_id, round(avg(v) + 1e-9, 6) AS confidence FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w USING (user_id) GROUP BY u.user_id""",
    "softmax_entropy": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top FROM v),
l AS (SELECT vec_id, v, top + ln(list_sum(list_transform(v, lambda x: exp(x - top)))) AS lse FROM m), p AS (SELECT vec_id, list_transform(v, lambda x: exp(x - lse)) AS p FROM l),
h AS (SELECT vec_id, p, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-300)))) AS h FROM p)
SELECT vec_id, round(greatest(0.0, least(1.0, (exp(-h) - 1.0::DOUBLE / len(p)) / (1.0::DOUBLE - 1.0::DOUBLE / len(p)))), 6) AS confidence, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS best FROM h""",
    "log_sum_exp": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top FROM v) SELECT vec_id, round(top + ln(list_sum(list_transform(v, lambda x: exp(x - top)))), 6) AS lse FROM m",
    "two_level_confidence": "WITH w AS (SELECT user_id, event_id // 7 AS word, min(value) AS v FROM events GROUP BY ALL) SELECT user_id, round(avg(v) + 1e-9, 6) AS confidence FROM w GROUP BY user_id",
    "greedy_collapse": """WITH t AS (SELECT vec_id // 20 AS chunk, vec_id, CAST(list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS BIGINT) AS token FROM embeddings),
g AS (SELECT *, CASE WHEN lag(token) OVER w IS NOT DISTINCT FROM token AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY chunk ORDER BY vec_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS run FROM g), o AS (SELECT chunk, run, token, count(*) AS frames FROM n WHERE token <> 0 GROUP BY chunk, run, token)
SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY run) AS place, token, frames FROM o""",
}
