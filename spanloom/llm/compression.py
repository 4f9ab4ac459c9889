"""Quality rules with compression bands: zstandard ratios over whole texts and fixed chunks.

Repetitive text compresses far below prose of its length, random text hardly at all; how far depends on the length, as
a short text has little to refer back to. Every length class (``CLASSES`` to a doubling of the bytes) therefore has its
own band of allowed ratios (compressed by raw bytes), for the whole text and for chunks of fixed size, where a chunk
belongs to the class of its own length. A text is rejected if its whole ratio leaves its band, or if over
``CHUNK_SHARE`` of its bytes stand in chunks that leave theirs. A last chunk of less than half a chunk is part of the one
before it, so every byte of a long text is judged.

The bands are fitted on good documents: of the rows with label 1 (without the held-out fold) one in ``OUTSIDE`` lies below a
class's band and one above, and ``MARGIN`` is added on both sides. The counts are summed over all such rows by class and
ratio. A class with fewer than ``LEAST_ROWS`` of them takes in the classes next to it, one on either side at a time, until there are as
many or no more; so every class is fitted, the same way at every size. Without any such row all have the wide bands of ``WIDE``.

Defined results: null text counts as empty; a text without words fails the base rules and so isn't kept; texts of fewer
than ``LEAST_BYTES`` bytes are judged by the base rules alone; repeated rows are judged alike, each on its own, and count
once each in the fit, as do repeated labels; null labels and ids say nothing there. Only doc_id and text are read; an
empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold, map_rows, table, texts
from spanloom.plans.scratch import materialise

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.5
#: Bytes from which ratios are judged, and length classes to a doubling of the bytes.
LEAST_BYTES, CLASSES = 200, 2
#: The fit: one in so many good rows lies beyond either limit, what is added to both, rows that a class or its neighbourhood needs, bins of a ratio of one.
OUTSIDE, MARGIN, LEAST_ROWS, BINS = 1000, 0.01, 100, 400
FOLDS, HELD_OUT = 5, 0
#: Where nothing is learned: bytes from which a band holds, least ratio, greatest ratio.
WIDE = ((200, 0.35, 0.85), (500, 0.33, 0.80), (1000, 0.30, 0.75), (2000, 0.28, 0.70), (4000, 0.25, 0.65), (16000, 0.20, 0.62))
#: Base limits: words, and per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = b"#*$%&|<>"

Bands = dict[int, tuple[float, float]]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    white = data.count(b" ") + sum(map(data.count, (b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(data.count(bytes([s])) for s in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")] if b"\n" in data else ()
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        size = len(number)
        if size < 2_000_000:
            keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        else:  # three numbers no longer fit one
            _, inverse, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
        twice = counts[inverse.ravel()] > 1
        if twice.any():
            covered = np.zeros(n, dtype=bool)
            for i in range(3):
                covered[i : n - 2 + i] |= twice
            repeated = int(covered.sum())
    return n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated


def cut(data: bytes) -> list[bytes]:
    """The chunks of a text: none if it is no longer than one."""
    if len(data) <= CHUNK:
        return []
    n = len(data) // CHUNK + (len(data) % CHUNK >= CHUNK // 2)
    ends = [*range(CHUNK, n * CHUNK, CHUNK), len(data)]
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, and bytes and ratio of the whole text and of its chunks, for every row."""

    def make():
        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts(batch):
                data = text.encode("utf-8", "surrogatepass")
                parts = cut(data)
                whole = len(compress(data)) / len(data) if data else 0.0
                rows.append((*base_counts(text), len(data), whole, [len(p) for p in parts], [len(compress(p)) / len(p) for p in parts]))
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

        return f

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bytes", "ratio", "chunk_bytes", "chunk_ratios"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_rows(documents.select("doc_id", "text"), make, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[:6]) + ", ratio double, chunk_bytes array<int>, chunk_ratios array<double>")


def _class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1))) * CLASSES + 1e-9).cast("int")


def wide_bands() -> Bands:
    """The bands of all classes where nothing is learned, each the widest of those that hold for its lengths."""
    found: Bands = {}
    for k in range(int(math.log2(LEAST_BYTES) * CLASSES), 64 * CLASSES):
        low, high = 2 ** (k / CLASSES), 2 ** ((k + 1) / CLASSES)
        own = [w for w, after in zip(WIDE, [*WIDE[1:], (math.inf,)], strict=True) if w[0] < high and low < after[0]]
        found[k] = min(w[1] for w in own), max(w[2] for w in own)
    return found


def fit_bands(measures: DataFrame, labels: DataFrame, label: str = "quality") -> Bands:
    """The bands of all classes by the rows whose label is 1, without the held-out fold."""
    good = labels.where((F.col(label) == 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id")
    rows = measures.where(F.col("bytes") >= LEAST_BYTES).select("doc_id", _class(F.col("bytes")).alias("class"), F.floor(F.col("ratio") * BINS).cast("int").alias("bin")).join(good, "doc_id")
    counts: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("class", "bin").agg(F.count("*").alias("n")).collect():  # as many rows as classes and bins
        counts.setdefault(r["class"], {})[r["bin"]] = r["n"]
    bands = wide_bands()
    if counts:
        for k in bands:
            own, n = _pooled(counts, k)
            bands[k] = _edge(sorted(own.items()), n) / BINS - MARGIN, (_edge(sorted(own.items(), reverse=True), n) + 1) / BINS + MARGIN
    return bands


def _pooled(counts: dict[int, dict[int, int]], k: int) -> tuple[dict[int, int], int]:
    """Rows by bin, and their number, of the fewest classes around ``k`` that have LEAST_ROWS, or of all."""
    farthest = max(abs(j - k) for j in counts)
    own: dict[int, int] = {}
    for reach in range(farthest + 1):
        for j in {k - reach, k + reach}:
            for b, n in counts.get(j, {}).items():
                own[b] = own.get(b, 0) + n
        if sum(own.values()) >= LEAST_ROWS:
            break
    return own, sum(own.values())


def _edge(bins: list[tuple[int, int]], n: int) -> int:
    """The first bin before which at most one in OUTSIDE of the rows lies."""
    before = 0
    for b, count in bins:
        before += count
        if before * OUTSIDE > n:
            return b
    raise ValueError("no rows")


def _outside(size: Column, ratio: Column, bands: Bands) -> Column:
    """Whether a ratio leaves the band of its length; too short to judge: no."""
    first = min(bands)
    limits = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for _, (low, high) in sorted(bands.items())])
    at = F.least(F.greatest(_class(size) - first, F.lit(0)), F.lit(len(bands) - 1))
    return (size >= LEAST_BYTES) & ((ratio < limits[at]["low"]) | (ratio > limits[at]["high"]))


def judged(measures: DataFrame, bands: Bands) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the ratios that decided, for every row of ``measured``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    bad = F.aggregate(F.zip_with("chunk_bytes", "chunk_ratios", lambda b, r: F.when(_outside(b, r, bands), b).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.when(F.size("chunk_bytes") == 0, _outside(F.col("bytes"), F.col("ratio"), bands).cast("double")).otherwise(bad / F.greatest("bytes", F.lit(1)))
    own = measures.withColumn("base_failed", failed).withColumn("bad_chunk_share", share)
    kept = ~F.col("base_failed") & ~_outside(F.col("bytes"), F.col("ratio"), bands) & (F.col("bad_chunk_share") <= CHUNK_SHARE)
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "ratio", "bad_chunk_share")


def judge(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The verdict on every row, by bands fitted on the labels, or by the wide ones without them."""
    if labels is None:
        return judged(measured(documents), wide_bands())
    measures = materialise(measured(documents), "compression")
    return judged(measures, fit_bands(measures, labels))


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
