"""Licence scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame operations only.

Templates are short and documents long, so a document is compared window by window. Templates are put in size classes;
a class's windows are twice as long as its longest template and overlap by half, so a template's words always lie in
one window. From the sizes follows the least Jaccard similarity of a window that contains the threshold's share of a
template, and from that the number of bands (of one MinHash each) that makes one collide with probability
``CERTAINTY`` at least. Windows that share a band with a template are held to exact containment of its shingles. Of
templates that are versions of one text a document states, at each place, those it contains best there: a version gives
way only to a better one that covers more than half of the same words.

A window with containment t of a template of n shingles lacks at most (1 - t) n of them, so it holds one of any
``floor((1 - t) n) + 1`` that are picked beforehand, and so a picked shingle's longest word. Windows without such a
word of their class aren't built. The words are chosen to cover the picks with few and long words; the test reads the
whole text of every document and loses nothing.

Defined results: words are runs of letters and digits in lower case; a text of fewer words than a shingle is one
shingle; null and wordless texts match nothing. Rows that repeat id and text are reported once. A document may state
several licences. Columns beside doc_id and text are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import row_key, table
from spanloom.llm.license_texts import TEMPLATES

SHINGLE, THRESHOLD = 5, 0.8
#: Inserted words that a template's place may hold.
SLACK = 8
#: Least probability that a window which contains a template meets it in a band.
CERTAINTY = 1 - 1e-6


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str], n: int = SHINGLE) -> list[str]:
    n = min(n, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))) if n else []


@dataclass
class SizeClass:
    """Templates of like size: their numbers, the stride of the windows, the bands, and the words that a window must hold."""

    members: list[int]
    stride: int
    bands: int
    pivots: list[str]


def pivot_words(shingles: list[list[str]], threshold: float, known: set[str]) -> list[str]:
    """Words of which every window that contains one of the templates holds one; known words are taken first."""
    found: list[str] = []
    for own in shingles:
        need = int((1 - threshold) * len(own) + 1e-9) + 1
        left = set(own)

        def covered() -> int:
            return len(own) - len(left)

        for word in [w for w in found if len(w) > 1]:
            left = {s for s in left if word not in s.split()}
        while covered() < need:
            counts = Counter(w for s in left for w in set(s.split()))
            best = max(counts, key=lambda w: (w in known, min(len(w), 12), counts[w], w))
            found.append(best)
            left = {s for s in left if best not in s.split()}
    return found


def size_classes(shingles: list[list[str]], n: int = SHINGLE, threshold: float = THRESHOLD, certainty: float = CERTAINTY, spans: list[int] | None = None) -> list[SizeClass]:
    """Classes of doubling size with the bands that guarantee the certainty. ``spans``: places of the shingles, where some are equal."""
    by: dict[int, list[int]] = {}
    for i, own in enumerate(shingles):
        if own:
            by.setdefault((len(own) - 1).bit_length(), []).append(i)
    classes, known = [], set()
    for _, members in sorted(by.items()):
        sizes = [len(shingles[i]) for i in members]
        stride = max(max(sizes), *((spans[i] for i in members) if spans else (0,))) + n - 1
        least = min(math.ceil(threshold * s - 1e-9) / (2 * stride - n + 1 + s - math.ceil(threshold * s - 1e-9)) for s in sizes)
        pivots = pivot_words([shingles[i] for i in members], threshold, known)
        known |= set(pivots)
        classes.append(SizeClass(members, stride, math.ceil(math.log(1 - certainty) / math.log(1 - least)), pivots))
    return classes


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def families(shingles: list[list[str]]) -> list[int]:
    """For each template the first of those it shares most shingles with, directly or by others: versions of one text."""
    first = list(range(len(shingles)))
    for i, own in enumerate(shingles):
        for j in range(i):
            if own and shingles[j] and len(set(own) & set(shingles[j])) > 0.5 * min(len(own), len(shingles[j])):
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    return first


def _windows(k: int, c: SizeClass) -> Column:
    """The class's windows of a row that hold one of its words."""
    hit = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*c.pivots), i)), lambda i: i.isNotNull())
    numbers = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array((i / c.stride).cast("int"), F.greatest((i / c.stride).cast("int") - 1, F.lit(0))))))
    return F.transform(numbers, lambda w: F.struct(F.lit(k).alias("class"), (w * c.stride).cast("int").alias("at"), F.slice("words", w * c.stride + 1, 2 * c.stride).alias("window")))


def _shingles(window: Column) -> Column:
    last = F.greatest(F.size(window) - SHINGLE + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(window, i, SHINGLE), " "))


def _places(threshold: float) -> Column:
    """Where the template lies in the window: each start from which as many words as its own (and a few inserted ones) hold enough of it, with the share."""
    n = F.col("n")
    hits = F.filter(F.transform("have", lambda s, i: F.struct((F.col("at") + i).alias("i"), F.array_position("wanted", s).alias("j"))), lambda h: h["j"] > 0)
    length = F.col("span") + F.least(F.lit(SLACK), F.floor(F.col("span") / 4))

    def place(start: Column, shared: Column) -> Column:
        return F.struct((shared / n).alias("score"), (F.col("shared") / n).alias("whole"), start.cast("int").alias("start"), n.alias("n"), F.col("template"), F.col("shared"), F.col("span"))

    def starts(h: Column) -> Column:
        inside = lambda p: F.size(F.array_distinct(F.transform(F.filter(h, lambda x: (x["i"] >= p["i"]) & (x["i"] < p["i"] + length)), lambda x: x["j"])))
        found = F.filter(F.transform(h, lambda p: place(p["i"], inside(p))), lambda x: x["score"] >= threshold - 1e-9)
        # Words inserted at length: the whole window's share stands for its place.
        return F.when(F.size(found) > 0, found).otherwise(F.array(place(h[0]["i"], F.col("shared"))))

    return F.element_at(F.transform(F.array(hits), starts), 1)


def _standing(places: Column) -> Column:
    """Of places by falling share those of which no better standing one covers more than half."""

    def covered(acc: Column, x: Column) -> Column:
        def by(a: Column) -> Column:
            both = F.least(a["start"] + a["span"], x["start"] + x["span"]) - F.greatest(a["start"], x["start"])
            return (F.struct(a["score"], a["whole"]) > F.struct(x["score"], x["whole"])) & (2 * both > x["span"])

        return F.exists(acc, by)

    return F.aggregate(places, F.slice(places, 1, 0), lambda acc, x: F.when(covered(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def _signature(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))).alias("least")))


def license_matches(documents: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, form, n_shared, n_template and containment of each document and template that some window contains."""
    spark = documents.sparkSession
    shingles = [shingles_of(words_of(t[2])) for t in templates]
    # Places of a template's shingles, of which some may be equal.
    spans = [max(1, len(words_of(t[2])) - SHINGLE + 1) for t in templates]
    classes = size_classes(shingles, threshold=threshold, spans=spans)
    # The templates are a fixed list, so their signatures are fit to be sent to all tasks.
    listed = F.array(*[F.struct(F.lit(k).alias("t_class"), F.lit(i).alias("template"), F.lit(spans[i]).alias("span"), _literals(shingles[i]).alias("wanted")) for k, c in enumerate(classes) for i in c.members])
    by_class = lambda column, make: F.coalesce(*[F.when(column == k, make(c)) for k, c in enumerate(classes)])
    known = spark.range(1).select(F.inline(listed))
    signed = known.select("t_class", "template", "span", "wanted", F.explode(by_class(F.col("t_class"), lambda c: _signature(F.col("wanted"), c.bands))).alias("t_sign"))

    lower, pivots = F.lower("text"), sorted({p for c in classes for p in c.pivots})
    # Through a lambda, so that each text is lower-cased once for all words.
    may = F.exists(F.array(lower), lambda t: reduce(or_, [t.contains(p) for p in pivots]))
    own = documents.select("doc_id", row_key("doc_id", "text").alias("row"), "text").where(may)
    own = own.select("doc_id", "row", F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    windows = own.select("doc_id", "row", F.explode(F.flatten(F.array(*[_windows(k, c) for k, c in enumerate(classes)]))).alias("w")).select("doc_id", "row", "w.class", "w.at", "w.window")
    cut = windows.select("doc_id", "row", "class", "at", _shingles(F.col("window")).alias("have"))
    bands = cut.select("doc_id", "row", "class", "at", "have", F.explode(by_class(F.col("class"), lambda c: _signature(F.col("have"), c.bands))).alias("sign"))
    met = bands.join(F.broadcast(signed), (F.col("class") == F.col("t_class")) & (F.col("sign.band") == F.col("t_sign.band")) & (F.col("sign.least") == F.col("t_sign.least")))
    shared = met.select("doc_id", "row", "template", "span", "at", "have", "wanted", F.size(F.array_intersect("have", "wanted")).alias("shared"), F.size("wanted").alias("n"))
    kept = shared.where(F.col("shared") >= threshold * F.col("n") - 1e-9)
    # Of the versions of one text the best agreed stand at each place, as a notice of one version holds most of the others' words.
    family = F.element_at(F.array(*map(F.lit, families(shingles))), F.col("template") + 1)
    placed = kept.select("doc_id", "row", family.alias("family"), F.explode(_places(threshold)).alias("p")).distinct()
    by = placed.groupBy("doc_id", "row", "family").agg(F.sort_array(F.collect_list("p"), asc=False).alias("places"))
    stated = by.select("doc_id", "row", "places", F.explode(F.array_distinct(F.transform(_standing(F.col("places")), lambda x: F.struct(x["template"].alias("template"), x["n"].alias("n"))))).alias("t"))
    own = F.filter("places", lambda x: x["template"] == F.col("t.template"))
    kept = stated.select("doc_id", "t.template", "t.n", F.array_max(F.transform(own, lambda x: x["shared"])).alias("shared"))
    name = lambda j: F.element_at(_literals([t[j] for t in templates]), F.col("template") + 1)
    return kept.select(
        "doc_id",
        name(0).alias("license"),
        name(1).alias("form"),
        F.col("shared").cast("long").alias("n_shared"),
        F.col("n").cast("long").alias("n_template"),
        (F.col("shared") / F.col("n")).alias("containment"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for the registered query: template shingles against all shingles of each document."""
    shingles = [shingles_of(words_of(t[2])) for t in TEMPLATES]
    wanted = ", ".join(f"({i}, '{s}')" for i, own in enumerate(shingles) for s in own)
    named = ", ".join(f"({i}, '{t[0]}', '{t[1]}', {f}, {len(s)})" for i, (t, f, s) in enumerate(zip(TEMPLATES, families(shingles), shingles, strict=True)))
    return rf"""
WITH t(template, s) AS (VALUES {wanted}), k(template, license, form, family, n) AS (VALUES {named}),
d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
r AS (SELECT row_number() OVER () AS r, doc_id, w FROM d WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM r),
m AS (SELECT r, doc_id, template, count(*) AS n_shared FROM ds JOIN t USING (s) GROUP BY ALL)
SELECT doc_id, license, form, n_shared, CAST(n AS BIGINT) AS n_template, n_shared::DOUBLE / n AS containment
FROM m JOIN k USING (template) WHERE n_shared >= {THRESHOLD} * n - 1e-9 QUALIFY rank() OVER (PARTITION BY r, family ORDER BY n_shared::DOUBLE / n DESC) = 1
"""
