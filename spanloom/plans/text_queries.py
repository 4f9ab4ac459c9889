"""Text functions over ``documents``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.sources.tables import micros, read


def tokens_count(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def norm_hash(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.sha2(X.norm("text").cast("binary"), 256).alias("norm_sha256"))


def content_id(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("id"))


def exact_dedup_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of texts equal after normalisation: the least id stands for each."""
    keyed = read(spark, folder, "documents").select("doc_id", F.sha2(X.norm("text").cast("binary"), 256).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")


def phrase_count(spark: SparkSession, folder: str) -> DataFrame:
    """Completed terms by whole tokens."""
    t = read(spark, folder, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size(F.filter("t", lambda w: w.isin("the", "and", "des", "der"))).cast("long").alias("n"))


def bigram_phrase_count(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of the two-token phrase "of the"."""
    t = read(spark, folder, "documents").select("doc_id", X.tokens("text").alias("t"))
    pairs = F.zip_with("t", F.slice("t", 2, 1_000_000_000), lambda a, b: (a == "of") & (b == "the"))
    return t.select("doc_id", F.size(F.filter(pairs, lambda p: p)).cast("long").alias("n"))


def ordered_concat(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "conversations")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return c.groupBy("conv_id").agg(F.array_join(parts, " ").alias("text"))


def stamp_format(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return e.select("event_id", X.stamp((micros("ts") % 400_000_000_000) / 1e6).alias("stamp"), X.stamp(F.col("value")).alias("value_stamp"))


def sentence_ends(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "conversations").select("conv_id", "turn", X.ends_sentence("text").alias("ends"))


def split_words(spark: SparkSession, folder: str) -> DataFrame:
    w = read(spark, folder, "conversations").select("conv_id", "turn", X.split_words("text").alias("w"))
    return w.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("text"))


def affix_tests(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "part")
    return p.select("p_partkey", F.startswith("p_name", F.lit("A")).alias("starts"), F.endswith("p_name", F.lit("s")).alias("ends"), F.right("p_name", F.lit(3)).alias("tail"), F.substring_index("p_name", " ", -1).alias("after_last"))


def id_formats(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return o.select("o_orderkey", F.concat(F.lit("S"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("segment"), F.concat(F.lit("rev-"), F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0")).alias("revision"))


def hex_id_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of 32 hex digits, some of them spoilt."""
    d = read(spark, folder, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    given = F.when(F.col("doc_id") % 3 == 0, F.concat("h", F.lit("/"))).when(F.col("doc_id") % 3 == 1, F.upper("h")).otherwise(F.col("h"))
    return d.select("doc_id", given.rlike("^[0-9a-f]{32}$").alias("valid"))


def json_predicate(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, folder, "events").where(k >= 50).select("event_id", k.alias("k"))


def nonempty_text(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").where(F.trim("text") != "").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def token_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Word differences of adjacent turns; the difference itself is a pandas function."""
    c = read(spark, folder, "conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return pairs.select("a.conv_id", "a.turn", F.explode(X.token_diff("a.text", "b.text")).alias("d")).select("conv_id", "turn", "d.a", "d.b", "d.operation")


def token_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every token of every document with its place: the library's table function in a lateral join."""
    return read(spark, folder, "documents").select("doc_id", "text").lateralJoin(X.TokenPlaces(F.col("text").outer())).select("doc_id", "token", "start", F.col("end").alias("stop"))


QUERIES = {f.__name__: f for f in (tokens_count, norm_hash, content_id, exact_dedup_norm, phrase_count, bigram_phrase_count, ordered_concat, stamp_format, sentence_ends, split_words, affix_tests, id_formats, hex_id_guard, json_predicate, nonempty_text, token_diff, token_places)}

_TOKENS = r"regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ё', 'е'), '[\p{L}\p{N}_]+')"
_NORM = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]', '', 'g')"
_STAMP = "lpad(CAST({ms} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({ms} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(({ms} % 3600000) // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({ms} % 60000) // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"

ORACLE_SQL = {
    "token_places": r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS s FROM documents), x AS (SELECT doc_id, unnest(t) AS token, unnest(s[1:len(t)]) AS gap, unnest(range(len(t))) AS k FROM d),
y AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM x)
SELECT doc_id, replace(replace(lower(token), 'ß', 'ss'), 'ё', 'е') AS token, CAST(stop - length(token) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM y""",
    "token_diff": r"""WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations), p AS (SELECT row_number() OVER () AS r, a.conv_id, a.turn, a.w AS a, b.w AS b FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
x AS (SELECT r, unnest(a) AS t, unnest(range(len(a))) AS i FROM p), y AS (SELECT r, unnest(b) AS t, unnest(range(len(b))) AS j FROM p), m AS (SELECT r, i, j, i - row_number() OVER (PARTITION BY r, j - i ORDER BY i) AS g FROM x JOIN y USING (r, t)),
s AS (SELECT r, min(i) AS i, min(j) AS j, count(*) AS n FROM m GROUP BY r, j - i, g),
q(r, al, ah, bl, bh, hit) AS (SELECT p.r, 0::BIGINT, any_value(len(a))::BIGINT, 0::BIGINT, any_value(len(b))::BIGINT, min({'n': -n, 'i': i, 'j': j}) FROM p JOIN s USING (r) GROUP BY p.r
UNION ALL SELECT c.r, c.al, c.ah, c.bl, c.bh, min({'n': -(least(s.n, c.ah - s.i, c.bh - s.j) - greatest(c.al - s.i, c.bl - s.j, 0)), 'i': s.i + greatest(c.al - s.i, c.bl - s.j, 0), 'j': s.j + greatest(c.al - s.i, c.bl - s.j, 0)})
FROM (SELECT r, u.al, u.ah, u.bl, u.bh FROM (SELECT r, unnest([{'al': al, 'ah': hit.i, 'bl': bl, 'bh': hit.j}, {'al': hit.i - hit.n, 'ah': ah, 'bl': hit.j - hit.n, 'bh': bh}]) AS u FROM q)) c
JOIN s ON s.r = c.r AND least(s.n, c.ah - s.i, c.bh - s.j) > greatest(c.al - s.i, c.bl - s.j, 0) GROUP BY c.r, c.al, c.ah, c.bl, c.bh),
k AS (SELECT r, hit.i AS i, hit.j AS j, -hit.n AS n FROM q UNION ALL SELECT r, len(a), len(b), 0 FROM p), o AS (SELECT r, i, j, coalesce(lag(i + n) OVER v, 0) AS i0, coalesce(lag(j + n) OVER v, 0) AS j0 FROM k WINDOW v AS (PARTITION BY r ORDER BY i, j, n DESC))
SELECT conv_id, turn, array_to_string(p.a[i0 + 1:i], ' ') AS a, array_to_string(p.b[j0 + 1:j], ' ') AS b, CASE WHEN i > i0 AND j > j0 THEN 'replace' WHEN i > i0 THEN 'delete' ELSE 'insert' END AS operation FROM o JOIN p USING (r) WHERE i > i0 OR j > j0""",
    "tokens_count": f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents",
    "norm_hash": f"SELECT doc_id, sha256({_NORM}) AS norm_sha256 FROM documents",
    "content_id": "SELECT doc_id, left(sha256(text), 32) AS id FROM documents",
    "exact_dedup_norm": f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256({_NORM}) HAVING count(*) > 1",
    "phrase_count": f"SELECT doc_id, CAST(len(list_filter({_TOKENS}, lambda w: w IN ('the', 'and', 'des', 'der'))) AS BIGINT) AS n FROM documents",
    "bigram_phrase_count": f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS BIGINT) AS n FROM t",
    "ordered_concat": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "stamp_format": f"WITH m AS (SELECT event_id, CAST(round_even((epoch_us(ts) % 400000000000) / 1e6 * 1000, 0) AS BIGINT) AS ms, greatest(0, CAST(round_even(value * 1000, 0) AS BIGINT)) AS vm FROM events) SELECT event_id, {_STAMP.format(ms='ms')} AS stamp, {_STAMP.format(ms='vm')} AS value_stamp FROM m",
    "sentence_ends": """SELECT conv_id, turn, regexp_matches(text, '[.!?…]["»)]?$') AS ends FROM conversations""",
    "split_words": r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, array_to_string(w, ' ') AS text FROM w",
    "affix_tests": "SELECT p_partkey, starts_with(p_name, 'A') AS starts, ends_with(p_name, 's') AS ends, right(p_name, 3) AS tail, list_extract(string_split(p_name, ' '), -1) AS after_last FROM part",
    "id_formats": "SELECT o_orderkey, 'S' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS segment, 'rev-' || lpad(CAST(o_custkey % 1000000 AS VARCHAR), 6, '0') AS revision FROM orders",
    "hex_id_guard": "WITH d AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) SELECT doc_id, regexp_full_match(CASE doc_id % 3 WHEN 0 THEN h || '/' WHEN 1 THEN upper(h) ELSE h END, '[0-9a-f]{32}') AS valid FROM d",
    "json_predicate": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50",
    "nonempty_text": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE trim(text) <> '' GROUP BY lang",
}
