"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a vector of statistics, brought near a normal shape by logarithms. Each class has its mean and its
covariance; a covariance is shrunk towards the pooled one and that towards a scaled identity, so it stays well
conditioned with few rows. The score is the posterior of class 1: the difference of the two log densities, which are
Mahalanobis distances by the Cholesky factors computed once at fitting, plus the log prior odds, softened by a
temperature.

Fitting is by moments, which Spark sums over all labelled rows given to it; only two rows of sums reach the driver.

Defined results: null text counts as empty, and empty texts are scored like others. Labels that are null or neither 0
nor 1 are left out; a document with several labels counts once for each. With one class absent every score is that of
the class there is, and 0.5 without any label. An empty table gives none. Only doc_id and text are read; labels, lang,
source and doc_id never enter a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold, in_arrow, map_rows, slices, table, texts
from spanloom.plans.scratch import materialise

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
#: Weight of the pooled covariance in a class's, of the scaled identity in both, and the divisor of the log odds.
POOLED, IDENTITY, TEMPERATURE = 0.1, 0.02, 4.0
FEATURES = ("chars", "words", "word_length", "distinct_words", "same_as_next", "upper", "digits", "symbols", "marks", "white", "line_words", "distinct_lines", "packed", "not_ascii", "top_pair")
_DROPPED = 1e-2


def _log(x: float) -> float:
    return float(np.log(x + _DROPPED))


def features(text: str) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    k = len(words)
    if not k:
        return [_log(n), *[_log(0.0)] * (len(FEATURES) - 1)]
    lines = [x for x in data.split(b"\n") if x]
    unique = set(words)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    symbols = int(counts[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
    marks = int(counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    white = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    same = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        _log(n),
        _log(k),
        _log((n - white) / k),
        _log(1 - len(unique) / k),
        _log(same / k),
        _log(upper / (upper + lower + 1)),
        _log(int(counts[48:58].sum()) / n),
        _log(symbols / k),
        _log(marks / k),
        _log(white / n),
        _log(k / max(1, len(lines))),
        _log(1 - len(set(lines)) / max(1, len(lines))),
        _log(len(zlib.compress(data, 1)) / (n + 20)),
        _log(int(counts[128:].sum()) / n),
        _log(1 - (pairs + 1) / k),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior odds of class 1."""

    means: np.ndarray
    inverses: np.ndarray
    halves: np.ndarray
    odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of statistics."""
        if not len(self.means):
            return np.full(len(x), self.odds)
        densities = [-0.5 * np.square((x - m) @ w.T).sum(axis=1) - h for m, w, h in zip(self.means, self.inverses, self.halves, strict=True)]
        z = (densities[1] - densities[0] + self.odds) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(labelled: DataFrame, label: str) -> Discriminant:
    """Fits on all rows of ``labelled``, which holds an array of statistics ``x`` and the class in column ``label``."""
    size = len(FEATURES)

    def run(batches):
        sums = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            y = np.array(batch.column("y").to_pylist())
            x = batch.column("x").values.to_numpy().reshape(-1, size)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["y", "sums"])

    own = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), "x")
    parts = in_arrow(own, run, "y int, sums array<double>").select("y", F.posexplode("sums").alias("i", "s"))
    sums = np.zeros((2, 1 + size + size * size))
    for r in parts.groupBy("y", "i").agg(F.sum("s").alias("s")).collect():  # two classes by the moments' fixed number
        sums[r["y"], r["i"]] = r["s"]
    n = sums[:, 0]
    if not n.all():
        share = float(n[1] > 0) if n.any() else 0.5
        return Discriminant(np.empty((0, size)), np.empty((0, size, size)), np.empty(0), share)
    means = sums[:, 1 : size + 1] / n[:, None]
    scatter = sums[:, size + 1 :].reshape(2, size, size) - n[:, None, None] * np.einsum("ci,cj->cij", means, means)
    pooled = scatter.sum(axis=0) / n.sum()
    unit = np.eye(size) * max(np.trace(pooled) / size, 1e-6)
    inverses, halves = [], []
    for c in (0, 1):
        weight = max(POOLED, size / (size + n[c]))
        shrunk = (1 - IDENTITY) * ((1 - weight) * scatter[c] / n[c] + weight * pooled) + IDENTITY * unit
        factor = np.linalg.cholesky(shrunk)
        inverses.append(np.linalg.inv(factor))
        halves.append(np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverses), np.array(halves), float(np.log(n[1] / n[0])))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and ``x``, the array of statistics of the whole text, for every row."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t) for t in texts(batch)], pa.list_(pa.float64()))], names=["doc_id", "x"])

        return f

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_rows(documents.select("doc_id", "text"), make, f"doc_id {kind}, x array<double>")


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics with labels, without the held-out fold."""
    own = labels.select("doc_id", F.col(label).alias("y")).where(fold("doc_id", FOLDS) != HELD_OUT)
    return stats.join(own, "doc_id").select("x", "y")


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of statistics."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column("x").values.to_numpy().reshape(-1, len(FEATURES))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(x))], names=["doc_id", "score"])

        return f

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = map_rows(stats.select("doc_id", "x"), make, f"doc_id {kind}, score double", text="")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows, with all their columns, whose score reaches the cut."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(training_rows(statistics(documents), labels, label), "y"))

    def run(batches):
        for batch in (x for b in batches for x in slices(b)):
            scores = sent.value.scores(np.array([features(t) for t in texts(batch)]))
            yield batch.filter(pa.array(scores >= CUT))

    return in_arrow(documents, run, documents.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(statistics(table(spark, sf_dir, "documents")), "statistics")
    return score(stats, fit(training_rows(stats, table(spark, sf_dir, "labels")), "y"))
