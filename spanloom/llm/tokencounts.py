"""Token counts: pieces are counted once for each distinct pre-token and meet the documents' pre-token frequencies in a join.

A tokenizer (a ``.json`` of the tokenizers library) normalises a text and splits it into pre-tokens, each of which it turns
into pieces by itself. So a text's token count is the sum, over its distinct pre-tokens, of how often each stands there times
the number of its pieces. Three steps, none of which ever holds the ids of a text:

1. ``postings``: each slice of some megabytes of text is split by the library's own normaliser and pre-tokenizer. A slice gives
   one row for each distinct pre-token, with the documents that hold it and how often, and one row without a pre-token that
   names its documents. The table is written, so texts are read once.
2. ``pieces``: the distinct pre-tokens of all slices, each counted once by the library's model.
3. ``counted``: the two are joined and summed by document. The most common pre-tokens are broadcast: those held by at least
   one in ``HEAD`` of all (document, pre-token) pairs, of which there can't be more than ``HEAD``, and of at most ``HEAD_BYTES``
   bytes each. The rest meet in a plain join by pre-token, of whose keys none can be hot but very long ones; adaptive
   execution splits those.

Strings of special tokens in a text are one token each, as the library's default has it. Begin, end and added special tokens,
truncation and padding are left out.

Defined results: a null or empty text has no tokens and no bytes; texts of any length are read whole; repeated rows are
counted each; a null doc_id stays null; an empty table gives no rows. Only doc_id and text are read, whatever other columns
there are.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm.common import in_arrow, map_rows, slices, table, texts
from spanloom.plans.scratch import materialise

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens that are broadcast at most, and their bytes.
HEAD, HEAD_BYTES = 1_000_000, 64
#: Stretches of a text without white space that a task remembers the pre-tokens of, and how many new ones are split at once.
REMEMBERED, AT_ONCE = 400_000, 1000


class Splitter:
    """Pre-tokens of texts by the library's normaliser and pre-tokenizer; specials are pre-tokens of their own."""

    def __init__(self, path: str):
        own = json.load(open(path, encoding="utf-8"))
        library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in own["added_tokens"] if t["special"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["special"] for t in own["added_tokens"]):
            raise ValueError("added tokens must be special, plain and matched before normalisation")
        self.find = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normalised = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        #: Whether no pre-token holds white space, nor depends on it; then stretches between it are split by themselves.
        self.apart = self._drops_space(own.get("pre_tokenizer"))

    @staticmethod
    def _drops_space(pre_tokenizer: dict | None) -> bool:
        """Whether the first pre-tokenizer keeps only matches of a pattern whose classes are letters, digits and what is neither nor space."""
        first = ((pre_tokenizer or {}).get("pretokenizers") or [pre_tokenizer or {}])[0]
        pattern = first.get("pattern", {}).get("Regex", "") if isinstance(first.get("pattern"), dict) else ""
        classes = {r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
        return bool(first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and all(p in classes or re.fullmatch(r"'\w+", p) for p in pattern.split("|")))

    def of(self, text: str) -> list[str]:
        """All pre-tokens of a text, in order."""
        found: list[str] = []
        for i, part in enumerate(self.find.split(text) if self.find else [text]):
            if i % 2:
                found.append(part)
            elif part:
                found.extend(p for p, _ in self.split(self.normalised(part)))
        return found

    def of_each(self, parts: list[str]) -> list[list[str]]:
        """The pre-tokens of each of many stretches without ASCII white space, split in one call where that can be told apart."""
        joined = " ".join(parts)
        if self.find and self.find.search(joined):
            return [self.of(p) for p in parts]
        line = self.normalised(joined)
        if line.count(" ") != len(parts) - 1:  # other white space inside them
            return [self.of(p) for p in parts]
        found: list[list[str]] = [[] for _ in parts]
        edges = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") == 32)
        pieces = self.split(line)
        for i, (p, _) in zip(np.searchsorted(edges, [at[0] for _, at in pieces]).tolist(), pieces, strict=True):
            found[i].append(p)
        return found


class _Frequencies:
    """Pre-tokens of slices of texts as numbers, remembered by a task within bounds."""

    def __init__(self, splitter: Splitter):
        self.splitter = splitter
        self.clear()

    def clear(self) -> None:
        self.chunks: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat: list[int] = []  # numbers of the pre-tokens of all stretches, one after the other
        self.ends: list[int] = [0]

    def _counts(self, text: str) -> dict:
        if self.splitter.apart:
            return Counter(text.encode("utf-8", "surrogatepass").split())
        return Counter(self.splitter.of(text))

    def pairs(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pre-token and how often, by pre-token and then document, for the texts of a slice."""
        if len(self.chunks) > REMEMBERED:
            self.clear()
        counts = [self._counts(t) for t in rows]
        own = sum(map(len, counts))
        chunk = np.fromiter((n for c in counts for n in map(self.chunks.__getitem__, c)), np.int64, own)
        times = np.fromiter((n for c in counts for n in c.values()), np.int64, own)
        doc = np.repeat(np.arange(len(rows)), [len(c) for c in counts])
        self._learn()
        ends, flat = np.array(self.ends), np.array(self.flat, dtype=np.int64)
        size = ends[chunk + 1] - ends[chunk]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        word = flat[np.repeat(ends[chunk], size) + within]
        key, inverse = np.unique(word * max(1, len(rows)) + np.repeat(doc, size), return_inverse=True)
        total = np.bincount(inverse, np.repeat(times, size), len(key)).astype(np.int64)
        return key % max(1, len(rows)), key // max(1, len(rows)), total

    def _learn(self) -> None:
        """Splits the stretches that are new."""
        new = list(self.chunks)[len(self.ends) - 1 :]
        if not self.splitter.apart:  # they are pre-tokens already
            self.flat.extend(map(self.words.__getitem__, new))
            self.ends.extend(range(len(self.ends), len(self.ends) + len(new)))
            return
        for i in range(0, len(new), AT_ONCE):
            for found in self.splitter.of_each([c.decode("utf-8", "surrogatepass") for c in new[i : i + AT_ONCE]]):
                self.flat.extend(map(self.words.__getitem__, found))
                self.ends.append(len(self.flat))


def postings(documents: DataFrame, path: str) -> DataFrame:
    """slice, word, docs (numbers in the slice, ascending) and times; ids and bytes of the slice's documents where word is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = _Frequencies(Splitter(path)), count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch):
                doc, word, times = known.pairs(texts(part))
                first = np.flatnonzero(np.diff(word, prepend=-1))
                names, n = list(known.words), next(number)
                offsets = pa.array(np.append(first, len(word)), pa.int32())
                rows = [
                    pa.array(np.full(len(first), n)),
                    pa.array([names[i] for i in word[first].tolist()], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(doc, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    pa.nulls(len(first), pa.list_(part.column("doc_id").type)),
                ]
                yield pa.RecordBatch.from_arrays(rows, names=names_of)
                size = pa.array([0, part.num_rows], pa.int32())
                header = [
                    pa.array([n]),
                    pa.nulls(1, pa.string()),
                    pa.ListArray.from_arrays(size, pa.array(np.arange(part.num_rows), pa.int32())),
                    pa.ListArray.from_arrays(size, part.column("n_bytes")),
                    pa.ListArray.from_arrays(size, part.column("doc_id")),
                ]
                yield pa.RecordBatch.from_arrays(header, names=names_of)

    names_of = ["slice", "word", "docs", "times", "ids"]
    own = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return in_arrow(own, run, f"slice long, word string, docs array<int>, times array<long>, ids array<{kind}>")


def pieces(words: DataFrame, path: str) -> DataFrame:
    """``words`` with ``pieces``, the tokens that each word (a pre-token) is made of."""

    def make():
        library = Tokenizer.from_file(path)
        special = set(Splitter(path).special)
        tokens = library.model.tokenize

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([1 if w in special else len(tokens(w)) for w in batch.column("word").to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "pieces"])

        return f

    return map_rows(words, make, words.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", pieces long", "word")


def counted(found: DataFrame, known: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of all documents of ``postings``, by the pieces of ``known``; both are written tables."""
    pairs = known.agg(F.sum("pairs")).first()[0] or 0
    least = -(-pairs // head)  # no more than ``head`` words can have so many pairs
    common = known.where((F.col("pairs") >= least) & (F.octet_length("word") <= HEAD_BYTES)).select("word", "pieces")
    rows = found.where("word IS NOT NULL").select("slice", "word", "docs", "times")
    met = rows.join(F.broadcast(common), "word", "left")
    rest = known.where((F.col("pairs") < least) | (F.octet_length("word") > HEAD_BYTES)).select("word", "pieces")
    other = met.where("pieces IS NULL").drop("pieces").join(rest, "word").select("slice", "docs", "times", "pieces")
    both = met.where("pieces IS NOT NULL").select("slice", "docs", "times", "pieces").union(other)
    each = both.select("slice", "pieces", F.explode(F.arrays_zip("docs", "times")).alias("of")).select("slice", F.col("of.docs").alias("doc"), (F.col("of.times") * F.col("pieces")).alias("n"))
    sums = each.groupBy("slice", "doc").agg(F.sum("n").alias("n"))
    own = found.where("word IS NULL").select("slice", F.explode(F.arrays_zip("docs", "times", "ids")).alias("of"))
    named = own.select("slice", F.col("of.docs").alias("doc"), F.col("of.ids").alias("doc_id"), F.col("of.times").alias("n_bytes"))
    return named.join(sums, ["slice", "doc"], "left").select("doc_id", "n_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"))


def token_counts(documents: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens for every row, by the tokenizer at ``path``, which executors read."""
    found = materialise(postings(documents, path), "postings")
    words = found.where("word IS NOT NULL").groupBy("word").agg(F.sum(F.size("docs").cast("long")).alias("pairs"))
    return counted(found, materialise(pieces(words, path), "pieces"), head)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
