"""Substring dedup: repeated word windows found by compacting a de Bruijn graph of sampled k-mers.

Every word of a document that lies in a window of ``window`` consecutive words which also starts earlier (in a document
of smaller id, or earlier in the same one) is removed.

1. *Edges.* Of the k-mers of words in each window the one of least hash is sampled, so equal windows sample the same
   k-mer at the same place, and one k-mer in seven or so is an edge. Edges that occur once are left behind.
2. *Compaction.* For each repeated edge Spark sums up its occurrences and the stretches of words that lead to it from
   the edge before. If all occurrences share one stretch, and the edge before occurs as often, the step between the two
   doesn't branch. A join brings this to the documents' own edges, and runs of such steps are the compacted paths.
   All occurrences of a path hold the same words, so a path stands for all windows within it.
3. *Verification.* Each occurrence of a path, and each window that crosses a branch, becomes one row of a 128-bit digest
   of the words at its source coordinates. The least coordinate of each digest keeps its words; the rows after it
   lose theirs.

Groups are aggregated (counts, least values) before they are shuffled and joined, never gathered. What a document
gathers are its own positions.

Defined results: words are split at the six ASCII white spaces and compared as they are; null text has no words; fewer words than a
window lose none. Rows of equal id and text are one source, so copies of a row don't remove each other. Documents with a null id come
after all others. An empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, row_key, table, texts
from spanloom.plans.scratch import materialise, release

WINDOW, KMER = 20, 8
#: Bytes of text hashed in one pass, small enough for a core's cache.
PASS_BYTES = 1 << 17
#: Multiplier of the rolling hashes, and its inverse modulo 2**64.
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _rolled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in the multiplier, and the powers that bring a stretch of them back to its start."""
    n = len(values)
    if len(_powers[0]) <= n:
        for i, base in enumerate((_ODD, _BACK)):
            table = np.full(max(1 << 16, 2 * n), base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers[0][:n], out=sums[1:])
    return sums, _powers[1]


def _stretch(sums: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [low, high): equal for equal values, wherever they stand."""
    return _mixed((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _first_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash, by its upper half and then the first, in each run of ``width``."""
    least = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:  # runs of have and a shift of them make runs of up to twice as many
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return (least & ~_HIGH).astype(np.int64)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(given: list[str]) -> list[np.ndarray]:
    """For each text the hashes of its words, in passes over the bytes of many small texts or of one large one."""
    found, held, size = [], [], 0
    for text in given:
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= PASS_BYTES:
            found += _hashes_of(held)
            held, size = [], 0
    return found + (_hashes_of(held) if held else [])


def _hashes_of(data: list[bytes]) -> list[np.ndarray]:
    flat = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    turns = np.flatnonzero(np.diff(_WHITE[flat], prepend=True))  # word begins, word ends, by turns
    low, high = turns[::2], turns[1::2]
    sums, back = _rolled(flat.astype(np.uint64) + np.uint64(1))
    ends = np.cumsum([len(d) + 1 for d in data])
    return np.split(_stretch(sums, back, low, high), np.searchsorted(low, ends[:-1]))


class Sampled:
    """The sampled edges of one document: where they start, their hashes, and the edge that each window samples."""

    def __init__(self, words: np.ndarray, window: int = WINDOW, kmer: int = KMER):
        self.sums, self.back = _rolled(words)
        begin = np.arange(len(words) - kmer + 1)
        kmers = _stretch(self.sums, self.back, begin, begin + kmer)
        least = _first_least(kmers, window - kmer + 1)
        chosen = np.zeros(len(kmers), dtype=bool)
        chosen[least] = True
        self.at = np.flatnonzero(chosen)
        self.edges = kmers[self.at].view(np.int64)
        self.of_window = (np.cumsum(chosen) - 1)[least]

    def stretches(self) -> np.ndarray:
        """Hash of the words from the edge before to each edge; zero for the first."""
        out = np.zeros(len(self.at), dtype=np.uint64)
        out[1:] = _stretch(self.sums, self.back, self.at[:-1], self.at[1:]) | np.uint64(1)
        return out.view(np.int64)


def edges(documents: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """edge, row, at and stretch of every sampled edge of the rows in columns row and text."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts, rows = [], []
            for row, words in zip(batch.column("row").to_pylist(), word_hashes(texts(batch)), strict=True):
                if len(words) >= window:
                    s = Sampled(words, window, kmer)
                    parts.append((s.edges, s.at.astype(np.int32), s.stretches()))
                    rows.append(np.full(len(s.at), row, dtype=np.int64))
            if not parts:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64())], names=["edge", "row", "at", "stretch"])
            e, a, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.concatenate(rows)), pa.array(a), pa.array(s)], names=["edge", "row", "at", "stretch"])

        return f

    return map_rows(documents.select("row", "text"), make, "edge long, row long, at int, stretch long")


def compacted(all_edges: DataFrame) -> DataFrame:
    """row and ``marks``: the row's repeated edges, each with its place, occurrences, and whether one stretch leads to it."""
    # Written first, so that both sides of a join are plain shuffles, of which Spark splits the hot keys.
    repeated = materialise(all_edges.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    occurrences = materialise(all_edges.join(repeated, "edge"), "repeated")
    release(all_edges, repeated)
    steps = occurrences.groupBy("edge").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    single = materialise(steps.where("low = high AND low <> 0").select("edge", F.lit(True).alias("single")), "single")
    marked = occurrences.join(single, "edge", "left").select("row", F.struct("at", "edge", "n", F.coalesce("single", F.lit(False)).alias("single")).alias("m"))
    marks = materialise(marked.groupBy("row").agg(F.collect_set("m").alias("marks")), "marks")
    release(occurrences, single)
    return marks


def coordinates(words: np.ndarray, at: np.ndarray, edge: np.ndarray, counts: np.ndarray, alone: np.ndarray, window: int = WINDOW, kmer: int = KMER) -> list[tuple[int, int]]:
    """(start, words) of the paths, and of the windows that cross a branch, which may be repeated.

    ``at``, ``edge``, ``counts`` and ``alone`` are the document's marks: places, edges, occurrences, whether one stretch leads there.
    """
    s = Sampled(words, window, kmer)
    n, single = np.zeros(len(s.at), dtype=np.int64), np.zeros(len(s.at), dtype=bool)
    where = np.minimum(np.searchsorted(s.at, at), len(s.at) - 1)
    # Marks of another row, where two keys meet, are left out; one of the same edge at the same place says the same.
    own = (s.at[where] == at) & (s.edges[where] == edge)
    n[where[own]], single[where[own]] = counts[own], alone[own]
    joined = np.zeros(len(s.at), dtype=bool)
    joined[1:] = single[1:] & (n[1:] > 1) & (n[1:] == n[:-1])
    path = np.cumsum(~joined) - 1
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(s.at)) - 1
    low, high = s.at[first], s.at[last] + kmer
    whole = (n[first] > 1) & (high - low >= window)
    starts = np.arange(len(s.of_window))
    around = path[s.of_window]
    inside = whole[around] & (starts >= low[around]) & (starts + window <= high[around])
    loose = np.flatnonzero((n[s.of_window] > 1) & ~inside)
    found = [(int(a), int(b - a)) for a, b in zip(low[whole], high[whole], strict=True)]
    return found + [(a, window) for a in loose.tolist()]


def spans(marked: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """The digest, row, id, start and length of what ``coordinates`` gives for rows of text and marks."""
    kind = marked.schema["doc_id"].dataType.simpleString()
    names = ["k1", "k2", "row", "check", "doc_id", "start", "length"]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, places, lengths, owner = [], [], [], []
            column = batch.column("marks")
            bounds, flat = column.offsets.to_numpy(), column.values
            marks = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "edge", "n", "single")]
            given = texts(batch)
            for i, hashes in enumerate(word_hashes(given)):
                own = slice(bounds[i], bounds[i + 1])
                found = coordinates(hashes, *(m[own] for m in marks), window, kmer) if len(hashes) >= window else []
                if not found:
                    continue
                words = words_of(given[i])
                joint = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                begins = [0, *ends]
                for start, length in found:
                    keys.append(xxhash.xxh3_128_digest(joint[begins[start] : ends[start + length - 1] - 1]))
                    places.append(start)
                    lengths.append(length)
                owner += [i] * len(found)
            key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            rows = pa.array(owner, pa.int64())
            columns = [pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), *(batch.column(c).take(rows) for c in ("row", "check", "doc_id")), pa.array(places, pa.int32()), pa.array(lengths, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return f

    return map_rows(marked, make, f"k1 long, k2 long, row long, check long, doc_id {kind}, start int, length int")


def repeated_spans(documents: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """row, check and ``gone``, the starts and lengths of the spans that the row has to lose; rows that lose none are absent.

    Columns ``row`` and ``check`` are two hashes of a row, together its name.
    """
    if not 1 <= kmer < window:
        raise ValueError("a k-mer must be shorter than the window")
    marks = compacted(materialise(edges(documents, window, kmer), "edges"))
    rows = materialise(spans(documents.select("row", "check", "doc_id", "text").join(marks, "row"), window, kmer), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("start").alias("start"))
    release(marks)
    first = materialise(rows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = rows.join(first, ["k1", "k2"]).where(place > F.col("first"))
    gone = materialise(later.groupBy("row", "check").agg(F.collect_set(F.struct("start", "length")).alias("gone")), "gone")
    release(rows, first)
    return gone


def keep_mask(n: int, gone: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in gone or ():
        if s["start"] + s["length"] <= n:
            edge[s["start"]] += 1
            edge[s["start"] + s["length"]] -= 1
    return np.cumsum(edge[:-1]) == 0


def remove_repeats(documents: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, the kept words joined by one space as ``kept``, n_words and n_removed, for every row."""
    own = documents.select("doc_id", "text", row_key("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check"))
    joined = own.join(repeated_spans(own, window, kmer), ["row", "check"], "left").select("doc_id", "text", "gone")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, sizes, removed = [], [], []
            for text, gone in zip(texts(batch), batch.column("gone").to_pylist(), strict=True):
                words = words_of(text)
                n = len(words)
                if gone:
                    mask = keep_mask(n, gone)
                    words = [words[i] for i in np.flatnonzero(mask).tolist()]
                kept.append(b" ".join(words))
                sizes.append(n)
                removed.append(n - len(words))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

        return f

    return map_rows(joined, make, f"doc_id {kind}, kept binary, n_words long, n_removed long")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for the registered query: every window of every document by its words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
