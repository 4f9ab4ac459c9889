"""Source divergence audit: how the sources of a language differ in their use of terms, by DuckDB over shards of the counts.

1. ``counts``: tasks count terms by (lang, source) over the texts they read, within bounds; Spark adds these up to one row for
   each (lang, source, term), with its occurrences and its documents, and writes them.
2. ``kept``: the rows are dealt to shards by a hash of lang and term, so that a shard has all sources of its terms. In each shard
   a DuckDB query counts a term's documents and occurrences in its language and keeps the terms in enough documents.
3. ``totals``: Spark adds up the kept terms V of each language and the occurrences N of each group and language.
4. ``partial``: each shard meets the totals and a DuckDB query gives, for each pair of sources, what its terms add to the pair's
   sum, and for each group its leading terms. Spark adds the parts up, and ranks.

The share of a term that a group lacks is the same for all such terms (``z``). So a pair's sum over all V terms is V times the
difference of the two z, plus, for terms that either group has, what the term's difference exceeds that by: shards only look at
terms that occur. Sources of a language are numbered and cut into blocks of ``SOURCES``; a task has the rows of one pair of
blocks in one shard, so that it holds at most 2 * ``SOURCES`` rows of a term and as many totals, however many sources there are.
A shard has about ``SHARD_ROWS`` rows. Leading terms are those of a shard first, then of all: the top ranks of all shards hold
the top ranks of the whole. All arithmetic is on integers (128 bits where products need them).

Defined results: null text, lang and source count as empty strings; repeated rows count each, in documents as in occurrences; a
(lang, source) group without terms is there, with its pairs; a language with one source has no pairs, one with no kept term has
sums of 0 and no terms; ties rank by item in UTF-8 order; an empty table gives no rows. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import in_arrow, slices, table, texts
from spanloom.plans.scratch import materialise, release

#: Documents that a kept term is in, what is added to each count, parts in a whole, leading terms of a group.
LEAST_DOCS, PRIOR, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Rows of counts in a shard, sources in a block, distinct (group, term) counts that a task holds before it hands them on.
SHARD_ROWS, SOURCES, HELD = 50_000, 64, 500_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Each ASCII byte that is no letter is a space, capitals are small: what is left of a text's UTF-8 are its terms.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

GROUP = "lang string, source string"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs of the texts read so far, whenever there are many of them, and at the end."""
    held: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0
    for batch in batches:
        for part in slices(batch):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts(part), strict=True):
                own = terms(text)
                n, docs = held[lang, source]
                size -= len(docs)
                n.update(own)
                docs.update(set(own))
                size += len(docs)
                if size > HELD:
                    yield from _rows(held)
                    held.clear()
                    size = 0
    yield from _rows(held)


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        if n:
            k = len(n)
            columns = [pa.repeat(pa.scalar(lang, pa.string()), k), pa.repeat(pa.scalar(source, pa.string()), k), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of every term of every group."""
    own = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = in_arrow(own, _counted, f"{GROUP}, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


@lru_cache(maxsize=1)
def _connection() -> duckdb.DuckDBPyConnection:
    """One connection for all shards of a worker, with one thread and bounded memory."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})


def _ask(tables: dict[str, pa.Table], query: str) -> pa.Table:
    """The result of a query over Arrow tables."""
    con = _connection()
    for name, own in tables.items():
        con.register(name, own)
    try:
        return con.sql(query).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


KEPT = f"""
WITH known AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n_lang FROM counts GROUP BY lang, term HAVING sum(docs) >= {LEAST_DOCS})
SELECT shard, lang, source, term, n, n_lang FROM counts JOIN known USING (lang, term)
"""


def kept(found: DataFrame, shards: int) -> DataFrame:
    """shard, lang, source, term, n and n_lang (in the whole language) of the terms that enough documents of a language hold."""
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")

    def run(rows: pa.Table) -> pa.Table:
        return _ask({"counts": rows}, KEPT)

    return found.select(shard, "*").groupBy("shard").applyInArrow(run, f"shard int, {GROUP}, term string, n long, n_lang long")


def _share(n: str, total: str, v: str) -> str:
    return f"CAST(1 + {WHOLE} * (CAST({n} AS HUGEINT) + {PRIOR}) // nullif({total} + {PRIOR} * CAST({v} AS HUGEINT), 0) AS BIGINT)"


def totals(documents: DataFrame, terms_kept: DataFrame) -> DataFrame:
    """lang, source, block, total and v (N and V), and total_lang, of every group that occurs."""
    names = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = terms_kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = terms_kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n"))
    langs = known.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang"))
    # A language's sources are one row each here; every one of them is a row of each other's result.
    block = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SOURCES).cast("int")
    out = names.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return out.select("lang", "source", block.alias("block"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "total_lang")])


def partial_query(first: int, second: int) -> str:
    """What the rows of a task add to the sums of the pairs of two blocks (x before y), and the leading terms where the blocks are one."""
    return f"""
WITH t AS (SELECT source, block, n AS total, v, total_lang, {_share("0", "n", "v")} AS z FROM rows WHERE term IS NULL),
p AS (SELECT source, term, block, z, {_share("r.n", "t.total", "t.v")} AS p, {_share("r.n_lang", "t.total_lang", "t.v")} AS q
      FROM (SELECT source, term, n, n_lang FROM rows WHERE term IS NOT NULL) r JOIN t USING (source)),
few AS (SELECT source, p, count(*) AS k FROM p GROUP BY ALL),
pairs AS (SELECT a.source AS x, b.source AS y, a.z AS zx, b.z AS zy FROM t a JOIN t b ON a.block = {first} AND b.block = {second} AND a.source < b.source),
sums AS (SELECT x, y, sum(k * (abs(p - zy) - abs(zx - zy))) AS s FROM pairs JOIN few ON few.source = x GROUP BY ALL
         UNION ALL
         SELECT x, y, sum(k * (abs(p - zx) - abs(zx - zy))) FROM pairs JOIN few ON few.source = y GROUP BY ALL
         UNION ALL
         SELECT a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(b.p - a.z) + abs(a.z - b.z))
         FROM p a JOIN p b ON a.term = b.term AND a.block = {first} AND b.block = {second} AND a.source < b.source GROUP BY ALL),
ahead AS (SELECT source, term, p - q AS f FROM p WHERE p > q AND {first} = {second}
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term) <= {RANKS})
SELECT x AS source, 'pair' AS part, y AS item, CAST(sum(s) AS BIGINT) AS value FROM sums GROUP BY ALL
UNION ALL SELECT source, 'term', term, f FROM ahead
"""


def partial(terms_kept: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """lang, source, part, item and value: sums of pairs and leading terms of each shard and pair of blocks."""
    last = groups.groupBy("lang").agg(F.max("block").alias("last"))
    place = groups.select("lang", "source", "block").join(last, "lang")
    own = terms_kept.join(place, ["lang", "source"]).select("shard", "lang", "source", "term", "n", "n_lang", "block", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("total_lang"), "last")
    # Every task needs the totals of its sources: they go to all shards.
    every = groups.join(last, "lang").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), F.lit(0).cast("long").alias("n_lang"), "block", "v", "total_lang", "last")
    other = F.explode(F.sequence(F.lit(0), "last")).alias("other")
    dealt = own.union(every).select("*", other).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other", "last")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, lang, first, second = (k.as_py() for k in key)
        found = _ask({"rows": rows}, partial_query(first, second))
        return found.add_column(0, "lang", pa.repeat(pa.scalar(lang, pa.string()), len(found)))

    return dealt.groupBy("shard", "lang", "first", "second").applyInArrow(run, f"{GROUP}, part string, item string, value long")


def ranked(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of all pairs and leading terms."""
    z = F.when(F.col("v") > 0, F.lit(1) + F.expr(f"{WHOLE * PRIOR} div (total + {PRIOR} * v)")).otherwise(F.lit(0))
    a = groups.select("lang", F.col("source").alias("x"), "v", z.alias("zx"))
    b = groups.select("lang", F.col("source").alias("y"), z.alias("zy"))
    sums = parts.where("part = 'pair'").groupBy("lang", F.col("source").alias("x"), F.col("item").alias("y")).agg(F.sum("value").alias("s"))
    # As many rows as the result has pairs.
    pairs = a.join(b, "lang").where("x < y").join(sums, ["lang", "x", "y"], "left").withColumn("value", F.coalesce("s", F.lit(0)) + F.col("v") * F.abs(F.col("zx") - F.col("zy")))
    each = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("of")
    whole = pairs.select("lang", "value", each).select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    leading = parts.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= RANKS)
    return whole.withColumn("rank", F.row_number().over(w)).unionByName(leading)


def audit(documents: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value and rank of the whole audit."""
    found = materialise(counts(documents), "counts")
    shards = max(1, -(-found.count() // shard_rows))
    terms_kept = materialise(kept(found, shards), "kept")
    groups = materialise(totals(documents, terms_kept), "totals")
    parts = materialise(partial(terms_kept, groups, shards), "partial")
    release(found, terms_kept)
    return ranked(parts, groups)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             unnest([''] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents),
known AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM d WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT g.lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN known USING (lang) GROUP BY g.lang),
own AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM d JOIN known USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN own USING (lang, source) GROUP BY s.lang, s.source),
p AS (SELECT g.lang, g.source, known.term, coalesce(own.n, 0) AS n,
        1 + {WHOLE} * (coalesce(own.n, 0) + {PRIOR}) // (g.total + {PRIOR} * v.v) AS p,
        1 + {WHOLE} * (known.n + {PRIOR}) // (v.total + {PRIOR} * v.v) AS q
      FROM g JOIN v ON v.lang = g.lang JOIN known ON known.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = known.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
           ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
