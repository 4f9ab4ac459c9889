"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the question is containment: which share of an item's word shingles
occurs in a document. Items are partitioned by their number of shingles, in classes that double. A class keeps a
bottom-k MinHash sketch of each item, the k shingles of least hash, with k set by the class's largest size n as
``floor((1 - threshold) * n) + 1``. A document that holds at least the threshold of an item's shingles lacks fewer
than k of them and so holds one of the sketch: candidates miss nothing, whatever the document's length. Each class is an index
of its own, in which a document's shingles are looked up; a hit's containment is then counted exactly on the shingles' words.

The index is the benchmark's, not the corpus's, and is sent to the workers in blocks of bounded size, each of which
meets all documents; so documents are never shuffled, however many items there are.

Defined results: words are runs of letters, digits and underscores in lower case; an item of fewer words than a shingle has
its whole sequence as its one shingle, and is in every document that holds those words in a row, however long; null or
wordless texts have none and match nothing. Repeated rows of either table are each reported. Ids may be of any type, and null.
Columns beside the ids and texts are ignored; empty tables match nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import in_arrow, slices, table, texts

SHINGLE, THRESHOLD = 5, 0.8
#: Characters of benchmark text in one block, which bounds what a worker holds.
BLOCK_CHARS = 4_000_000
#: Words a worker keeps hashed; the cache starts anew when full.
CACHED_WORDS = 150_000
_WORDS = re.compile(r"\w+").findall
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def normalised_words(text: str) -> list[str]:
    return _WORDS(text.lower())


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[str], n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of n words, in order; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _MULTIPLIER + h[i : i + len(out)]
    return _mixed(out)


def shingle_set(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


class SizeClass:
    """The sketches of the items of one class: sorted least hashes, and whose sketch each of them is in."""

    def __init__(self, exponent: int, threshold: float):
        #: Hashes in a sketch, by the largest size of the class.
        self.k = int((1 - threshold) * (1 << exponent) + 1e-9) + 1
        self._owners: dict[int, list[int]] = {}

    def add(self, item: int, hashes: np.ndarray) -> None:
        for h in hashes[: self.k].tolist():
            self._owners.setdefault(h, []).append(item)

    def close(self) -> None:
        self.keys = np.array(sorted(self._owners), dtype=np.uint64)
        self.owners = [self._owners[k] for k in self.keys.tolist()]
        del self._owners

    def candidates(self, hashes: np.ndarray) -> set[int]:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return {o for i in np.unique(at[self.keys[at] == hashes]).tolist() for o in self.owners[i]}


class ContainmentIndex:
    """Size-partitioned MinHash sketches of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.shingle, self.threshold, self.items = shingle, threshold, []
        classes: dict[int, SizeClass] = {}
        #: Items of fewer words than a shingle, by their number of words and the hash of all of them.
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            words = normalised_words(text or "")
            hashes = np.unique(shingle_hashes(words, shingle))
            if not len(hashes):
                continue
            if len(words) < shingle:
                self.short.setdefault(len(words), {}).setdefault(int(hashes[0]), []).append(len(self.items))
                self.items.append((item_id, words))
                continue
            exponent = (len(hashes) - 1).bit_length()
            if exponent not in classes:
                classes[exponent] = SizeClass(exponent, threshold)
            classes[exponent].add(len(self.items), hashes)
            self.items.append((item_id, words))
        self.classes = [classes[e] for e in sorted(classes)]
        for c in self.classes:
            c.close()
        # Which hashes may be in any class, by their last bits.
        keys = np.concatenate([c.keys for c in self.classes]) if classes else np.empty(0, dtype=np.uint64)
        bits = max(16, (len(keys) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(keys & self.mask).astype(np.int64)] = True

    def search(self, text: str) -> list[tuple[object, int, int]]:
        """(item id, shingles shared, shingles of the item) of every item that the whole text contains."""
        if not self.items or not text:
            return []
        words = normalised_words(text)
        found = self._short_items(words)
        hashes = shingle_hashes(words, self.shingle) if len(words) >= self.shingle and self.classes else np.empty(0, dtype=np.uint64)
        hashes = hashes[self.seen[(hashes & self.mask).astype(np.int64)]]
        if not len(hashes):
            return found
        candidates = set().union(*(c.candidates(hashes) for c in self.classes))
        if not candidates:
            return found
        have = shingle_set(words, self.shingle)
        for o in sorted(candidates):
            item_id, item_words = self.items[o]
            want = shingle_set(item_words, self.shingle)
            shared = len(want & have)
            if shared >= self.threshold * len(want) - 1e-9:
                found.append((item_id, shared, len(want)))
        return found

    def _short_items(self, words: list[str]) -> list[tuple[object, int, int]]:
        """Items of fewer words than a shingle that stand in the text as they are."""
        found = []
        for n, own in self.short.items():
            if len(words) < n:
                continue
            hashes = shingle_hashes(words, n)
            near = hashes[np.isin(hashes, np.array(list(own), dtype=np.uint64))]
            if len(near):
                have = shingle_set(words, n)
                found += [(self.items[o][0], 1, 1) for h in np.unique(near).tolist() for o in own[h] if tuple(self.items[o][1]) in have]
        return found


def _indexes(benchmark: DataFrame, shingle: int, threshold: float, block_chars: int):
    """A broadcast index for each block of the items; the number of blocks follows the size of the table."""
    items = benchmark.select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // block_chars) or 1
    context = benchmark.sparkSession.sparkContext
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield context.broadcast(ContainmentIndex([tuple(r) for r in own.toLocalIterator()], shingle, threshold))


def contained_items(documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every document and item with containment of the threshold or more."""
    ids = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, n_shared long, n_item long, containment double"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = None
    for index in _indexes(benchmark, shingle, threshold, block_chars):

        def run(batches, index=index):
            search = index.value.search
            for batch in (x for b in batches for x in slices(b)):
                rows, hits = [], []
                for i, text in enumerate(texts(batch)):
                    for hit in search(text):
                        rows.append(i)
                        hits.append(hit)
                if rows:
                    shared, size = [h[1] for h in hits], [h[2] for h in hits]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), pa.array([h[0] for h in hits], item_type), pa.array(shared, pa.int64()), pa.array(size, pa.int64()), pa.array([a / b for a, b in zip(shared, size, strict=True)])],
                        names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        part = in_arrow(documents.select("doc_id", "text"), run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, with all their columns, of documents that contain no item."""
    kept = documents
    for index in _indexes(benchmark, shingle, threshold, block_chars):

        def run(batches, index=index):
            search = index.value.search
            for batch in (x for b in batches for x in slices(b)):
                yield batch.filter(pa.array([not search(x) for x in texts(batch)], pa.bool_()))

        kept = in_arrow(kept, run, documents.schema)
    return kept


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB SQL for the registered query: all shingles of both tables, joined.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT q, item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT q, count(*) AS n_item FROM bs GROUP BY q), k AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT r, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d JOIN k ON len(w) >= k),
m AS (SELECT r, doc_id, q, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment FROM m JOIN n USING (q) WHERE n_shared >= 0.8 * n_item - 1e-9
"""
