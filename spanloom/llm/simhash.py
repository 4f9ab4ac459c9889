"""SimHash near-duplicate groups by a range join over segment bit counts.

A fingerprint is cut into short segments and embedded as the vector of their bit counts. One differing bit changes
one count by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints.
Fingerprints within the allowed distance are therefore near in the embedding, and a range join on a grid finds them:

* The segments are dealt into ``radius + 1`` grids. Of at most ``radius`` differing bits, the two grids with the fewest
  hold one at most, so in one of the pairs of grids (a *view*) the Manhattan distance is at most one.
* In each view every fingerprint registers in the cell of its counts and probes the cells in that range; of two
  mirror-image offsets only one is probed, so each pair of cells meets once.
* A cell that more than ``FULL`` fingerprints register in is split by the bits themselves: cut into ``radius + 1`` blocks, two
  fingerprints within the distance agree in one of the blocks, so only those with a block in common meet there.
* Pairs that meet are held to the Manhattan bound over the whole vector and then to the exact Hamming distance.

Only distinct fingerprints enter the join; rows with the same fingerprint are a group without any pair. Groups are the connected components of the links.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; a text
with fewer words than a shingle hashes its whole sequence. Rows may repeat; a null doc_id never becomes a
component's name unless all its ids are null. An empty table gives none. Only doc_id and text are read; other columns may
have any names and are handed on as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, map_rows, row_key, table, texts
from spanloom.plans.components import components
from spanloom.plans.scratch import materialise, release

BITS, SEED, SHINGLE = 64, 42, 3
#: Bits a segment; its count takes the values 0 to that number.
SEGMENT = 2
#: Fingerprints of one cell from which it is split, and fingerprints to a task where each becomes its probes.
FULL, TASK_PRINTS = 256, 20_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text: bit b is one if it is one in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and the six ASCII white spaces
    if not words:
        return 0
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(w), seed) for w in zip(*(words[i:] for i in range(n)))], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """All columns but text, and ``fp``, the fingerprint as a signed 64-bit number, for every row."""
    names = [c for c in documents.columns if c != "text"]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(x, shingle, seed) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps)], names=[*names, "fp"])

        return f

    kinds = "".join(f"{c} {documents.schema[c].dataType.simpleString()}, " for c in names)
    return map_rows(documents.select(*names, "text"), make, f"{kinds}fp long")


def _count(fp: Column, segment: int) -> Column:
    low = segment * SEGMENT
    return F.bit_count(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long")))


def _views(radius: int) -> tuple[list[list[int]], int]:
    """The segments of each view, and the Manhattan distance to search within it."""
    segments = list(range(BITS // SEGMENT))
    if radius < 1:
        return [segments], 0
    dealt = [segments[i :: radius + 1] for i in range(radius + 1)]
    return [sorted(a + b) for a, b in combinations(dealt, 2)], 1


def _steps(size: int, reach: int) -> list[dict[int, int]]:
    """Count offsets of at most ``reach`` in all, zero included, one of each mirror pair."""
    found: list[dict[int, int]] = [{}]
    for n in range(1, reach + 1):
        for places in combinations(range(size), n):
            moves: list[list[int]] = [[]]
            for _ in places:
                moves = [[*m, d] for m in moves for d in range(-reach, reach + 1) if d and sum(map(abs, m)) + abs(d) <= reach]
            found += [dict(zip(places, m, strict=True)) for m in moves if m[0] > 0]
    return found


def _cells(distinct: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(cell, fp) of each view, and (cell, fp, same) of the cells that each fingerprint probes; same: its own."""
    views, reach = _views(radius)
    base = SEGMENT + 1  # a cell's counts are the digits of its number, below the view's
    top = base ** max(map(len, views))
    counted = distinct.select("fp", *[_count(F.col("fp"), s).cast("long").alias(f"c{s}") for s in range(BITS // SEGMENT)])
    keys = [sum((F.col(f"c{s}") * F.lit(base**i) for i, s in enumerate(view)), F.lit(v * top).cast("long")).alias(f"k{v}") for v, view in enumerate(views)]
    keyed = counted.select("*", *keys)
    home = keyed.select("fp", F.explode(F.array(*[f"k{v}" for v in range(len(views))])).alias("cell"))
    moves = []
    for v, view in enumerate(views):
        for step in _steps(len(view), reach):
            cell = F.col(f"k{v}") + F.lit(sum(d * base**i for i, d in step.items()))
            fits = [F.col(f"c{view[i]}").between(max(0, -d), min(SEGMENT, SEGMENT - d)) for i, d in step.items()]
            valid = F.lit(True)
            for x in fits:
                valid = valid & x
            moves.append(F.when(valid, F.struct(cell.alias("cell"), F.lit(not step).alias("same"))))
    probe = keyed.select("fp", F.explode(F.array(*moves)).alias("p")).where("p IS NOT NULL").select("p.cell", F.col("fp").alias("other"), "p.same")
    return home, probe


def _manhattan(a: Column, b: Column) -> Column:
    return sum((F.abs(_count(a, s) - _count(b, s)) for s in range(BITS // SEGMENT)), F.lit(0))


def _blocks(fp: Column, radius: int) -> Column:
    """Number and bits of the blocks of a fingerprint."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    bits = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")) if high - low < BITS else fp for low, high in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("block"), x.alias("bits")) for i, x in enumerate(bits)])


def near_pairs(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints in column ``fp`` that differ in at most ``radius`` bits."""
    home, probe = _cells(distinct, radius)
    full = materialise(home.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("cell"), "full")
    a, b = F.col("fp"), F.col("other")
    near = (~F.col("same") | (a < b)) & (a != b) & (_manhattan(a, b) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)
    pair = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    met = home.join(full, "cell", "left_anti").join(probe, "cell").where(near).select(*pair)
    own = home.join(full, "cell", "left_semi").select("cell", "fp", F.inline(_blocks(a, radius)))
    others = probe.join(full, "cell", "left_semi").select("cell", "other", "same", F.inline(_blocks(b, radius)))
    return met.union(own.join(others, ["cell", "block", "bits"]).where(near).select(*pair)).distinct()


def _least_of_groups(prints: DataFrame, name: Column, radius: int) -> DataFrame:
    """``fp`` and ``least``, the least name among the rows of its group, for every distinct fingerprint."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(name).alias("first")), "distinct")
    # Spark sizes tasks by the bytes of fingerprints, of which each becomes dozens of rows.
    tasks = -(-distinct.count() // TASK_PRINTS) or 1
    roots = components(near_pairs(distinct.select("fp").repartition(tasks), radius)).withColumnRenamed("node", "fp")
    linked = roots.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    merged = linked.join(least, "root").select("fp", "least")
    # Written, so that the rows' join with it is between plain shuffles, of which Spark splits a hot fingerprint.
    groups = materialise(distinct.join(merged, "fp", "left").select("fp", F.coalesce("least", "first").alias("least")), "groups")
    release(distinct)
    return groups


def near_duplicate_groups(documents: DataFrame, radius: int = 2, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of the row's group, for every row."""
    prints = materialise(fingerprints(documents.select("doc_id", "text"), shingle, seed), "fingerprints")
    named = _least_of_groups(prints, F.col("doc_id"), radius)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each_group(documents: DataFrame, radius: int = 2, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each group with all its columns: that of the least doc_id; of rows with the same id and text, any one."""
    own = fresh("row", documents.columns)
    keyed = documents.withColumn(own, row_key("doc_id", "text"))
    prints = materialise(fingerprints(documents.select("doc_id", row_key("doc_id", "text").alias("row"), "text"), shingle, seed), "fingerprints")
    name = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    chosen = _least_of_groups(prints, name, radius).select(F.col("least.row").alias(own)).distinct()
    release(prints)
    # What is kept grows with the corpus, so it is never sent to all tasks, small as it may be here.
    return keyed.join(chosen.hint("merge"), own, "left_semi").dropDuplicates([own, "doc_id"]).select(*documents.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
