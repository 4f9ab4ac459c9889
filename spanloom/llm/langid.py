"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are lower-cased; every run of anything but letters becomes one boundary sign. The counts of character
four-grams by language are summed over all training rows. From them follow, for each language, the interpolated
Kneser-Ney probabilities of orders one to four: raw counts at the top, counts of distinct left neighbours below, one
discount an order. The four-grams of all languages stand in one sorted array of hashes beside a matrix of their log
probabilities, so a character costs one search for all languages; a four-gram that no language has seen backs off by
the models' own arrays. A text gets the language of least cross-entropy a character.

All counted four-grams make the models, however many. Models of more than ``SENT_CELLS`` log probabilities aren't sent
whole: counts, discounts and totals of all orders are tables, the log probabilities of the four-grams that occur in the
texts to be scored come from joins, and each block of them by hash meets all texts in a pass of its own.

A fold of the training rows is left out of the counts at first and calibrates two things: the score, the share of right answers
among fold rows of like evidence, made monotone; and rejection, for each language the cross-entropy that one in
``REJECTED`` of its fold rows exceeds. Both come from histograms with fixed bins, summed over the whole fold. The models that
predict are then made from the counts of all training rows, that fold's too; a language that only it holds rejects nothing.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if there is nothing to learn
from. Rows may repeat. Training ignores rows with null text or null language. Only doc_id (for the fold), text and, in
training, lang are read. Ties go to the language first in order. Texts are read whole, in pieces that overlap by three
signs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold, in_arrow, map_rows, slices, table, texts
from spanloom.plans.scratch import materialise

ORDER = 4
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
#: Log probabilities (four-grams times languages) that are sent to the workers at once; more go in several passes.
SENT_CELLS = 4_000_000
#: One in so many fold rows of a language lies above its limit of cross-entropy.
REJECTED = 1000
#: Characters worked on at once.
PIECE = 500_000
#: Bins of the histograms: of evidence, of cross-entropy, and of one nat of the latter.
EVIDENCE_BINS, ENTROPY_BINS, BINS_A_NAT = 60, 800, 50
_SIGN = 32
_LOW16 = np.uint64(0xFFFF)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the 16-bit sign of a letter, or that of a boundary."""
    signs = np.full(0x110000, _SIGN, dtype=np.uint16)
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()])
    signs[points] = np.where(points < 0x10000, points, 0xE000 + points % 0x1000)  # the rest shares the private-use area, which holds no letter
    return signs


def signs_of(text: str) -> np.ndarray:
    """The signs of a text between two boundaries; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    signs = _letters()[points]
    signs = np.concatenate([[_SIGN], signs, [_SIGN]]).astype(np.uint16)
    signs = signs[np.concatenate([[True], (signs[1:] != _SIGN) | (signs[:-1] != _SIGN)])]
    return signs if len(signs) > 1 else signs[:0]


def grams_of(signs: np.ndarray) -> np.ndarray:
    """Packed four-grams; the first ones begin with boundaries."""
    s = np.concatenate([np.full(ORDER - 2, _SIGN, dtype=np.uint16), signs]).astype(np.uint64)
    n = len(s) - ORDER + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | s[i : i + n]
    return out


def _hashed(keys: np.ndarray) -> np.ndarray:
    """A bijection that spreads packed four-grams evenly, so that a hash's first bits say where it stands."""
    h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class _Sorted:
    """Values by key in a sorted array of hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = _hashed(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(1, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.steps = int(np.diff(np.append(self.starts, len(keys))).max(initial=0))
        self.padded = np.append(self.hashes, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and whether each key is there."""
        h = _hashed(keys)
        at = self.starts[(h >> self.shift).astype(np.int64)]
        for _ in range(self.steps):
            at = at + (self.padded[at] < h)
        return np.minimum(at, max(0, len(self.hashes) - 1)), (self.padded[at] == h) & (at < len(self.hashes))


def discount_of(ones: float, twos: float) -> float:
    """From the numbers of grams with counts of one and two."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class KneserNey:
    """Interpolated Kneser-Ney log probabilities of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        grams: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):
            below, types = np.unique(grams[-1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
            grams.append((below, types.astype(np.float64)))
        self.levels: list[tuple[_Sorted, _Sorted]] = []
        signs = len(grams[-1][0]) + 1
        self.floor = 1.0 / signs
        for n, (own, c) in enumerate(reversed(grams), 1):
            ones, twos = float((c == 1).sum()), float((c == 2).sum())
            discount = discount_of(ones, twos)
            heads, which, types = np.unique(own >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(which, weights=c, minlength=len(heads))
            spare = discount * types / total
            lower = self.probability(own & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
            self.levels.append((_Sorted(own, (c - discount) / total[which] + spare[which] * lower), _Sorted(heads, spare)))

    def probability(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Of each packed n-gram's last sign after the others."""
        if n == 0:
            return np.full(len(keys), self.floor)
        seen, heads = self.levels[n - 1]
        at, there = seen.find(keys)
        out = seen.values[at] if len(seen.values) else np.zeros(len(keys))
        if not there.all():
            rest = keys[~there]
            spot, known = heads.find(rest >> np.uint64(16))
            spare = np.where(known, heads.values[spot], 1.0)
            out = out.copy()
            out[~there] = spare * self.probability(rest & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        return out


def _suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * n) - 1).cast("long"))


def _head(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _by_language(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for lang, v in values.items() for x in (lang, float(v))])[F.col("lang")]


class GramTables:
    """The same models as ``KneserNey`` makes, of any size: counts and totals by language as tables."""

    def __init__(self, grams: DataFrame, languages: list[str], sent_cells: int):
        self.languages, self.sent_cells = languages, sent_cells
        self.levels: list[tuple[DataFrame, DataFrame, Column]] = []
        level = grams.select("lang", "gram", F.col("n").cast("double").alias("c"))
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                level = materialise(level.groupBy("lang", _suffix(F.col("gram"), n).alias("gram")).agg(F.count("*").cast("double").alias("c")), "grams")
            sums = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos"), F.count("*").alias("n")).collect()  # a row a language
            discounts = {r["lang"]: discount_of(r["ones"], r["twos"]) for r in sums}
            self.floor = _by_language({r["lang"]: 1.0 / (r["n"] + 1) for r in sums})
            heads = level.groupBy("lang", _head(F.col("gram")).alias("head")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
            self.levels.insert(0, (level, materialise(heads, "heads"), _by_language(discounts)))

    def _probabilities(self, wanted: DataFrame, n: int) -> DataFrame:
        """lang, gram and p of each wanted n-gram in every language."""
        counts, heads, discount = self.levels[n - 1]
        languages = wanted.sparkSession.createDataFrame([(x,) for x in self.languages], "lang string")
        each = wanted.crossJoin(F.broadcast(languages)).join(counts, ["lang", "gram"], "left")
        each = each.withColumn("head", _head(F.col("gram"))).join(heads, ["lang", "head"], "left")
        lower = self.floor
        if n > 1:
            below = materialise(self._probabilities(wanted.select(_suffix(F.col("gram"), n - 1).alias("gram")).distinct(), n - 1), "probabilities")
            each = each.withColumn("suffix", _suffix(F.col("gram"), n - 1)).join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
            lower = F.col("lower")
        p = F.coalesce((F.col("c") - discount) / F.col("total"), F.lit(0.0)) + F.coalesce(discount * F.col("types") / F.col("total"), F.lit(1.0)) * lower
        return each.select("lang", "gram", p.alias("p"))

    def measured(self, rows: DataFrame) -> DataFrame:
        """The rows with ``sums``, the log probabilities of their text by language, and its ``size``, in place of ``text``."""
        width, context = len(self.languages), rows.sparkSession.sparkContext
        keyed = rows.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text")})
        wanted = materialise(gram_counts(rows.select("text", F.lit("").alias("lang"))).select("gram"), "wanted")
        place = F.create_map(*[x for i, lang in enumerate(self.languages) for x in (F.lit(lang), F.lit(i))])[F.col("lang")]
        lists = self._probabilities(wanted, ORDER).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(place.alias("i"), F.log("p").cast("float").alias("v")))).alias("l"))
        table = materialise(lists.select("gram", F.col("l.v").alias("values")), "vectors")
        blocks = -(-table.count() * width // self.sent_cells) or 1
        names, parts = [f"s{i}" for i in range(width)], None
        for b in range(blocks):
            own = table.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b).toArrow().combine_chunks()
            values = np.asarray(own.column("values").combine_chunks().flatten(), dtype=np.float32).reshape(-1, width)
            sent = context.broadcast(_Sorted(own.column("gram").to_numpy().view(np.uint64), values))

            def make(sent=sent):
                def look_up(grams: np.ndarray) -> np.ndarray:
                    if not len(sent.value.hashes):
                        return np.zeros((len(grams), width), dtype=np.float32)
                    at, there = sent.value.find(grams)
                    return sent.value.values[at] * there[:, None]  # zero, for other passes to add

                def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                    sums, sizes = sums_of(texts(batch), look_up, width)
                    return pa.RecordBatch.from_arrays([batch.column("__a"), batch.column("__b"), pa.array(sizes), *map(pa.array, np.ascontiguousarray(sums.T))], names=["__a", "__b", "size", *names])

                return f

            found = map_rows(keyed.select("__a", "__b", "text"), make, ", ".join(["__a long, __b long, size long", *[f"{x} double" for x in names]]))
            # Rows of one text are one row of sums.
            part = materialise(found.groupBy("__a", "__b", "size").agg(*[F.max(x).alias(x) for x in names]), "sums")
            sent.destroy()
            parts = part if parts is None else parts.unionByName(part)
        whole = materialise(parts.groupBy("__a", "__b", "size").agg(F.array(*[F.sum(x) for x in names]).alias("sums")), "sums")
        return keyed.drop("text").join(whole, ["__a", "__b"]).drop("__a", "__b")


def sums_of(given: list[str], look_up: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what is looked up for each text's four-grams, and its number of characters."""
    sums, sizes = np.zeros((len(given), width)), np.zeros(len(given), dtype=np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def settle() -> None:
        if held:
            values = look_up(np.concatenate(held))
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(sums, owners, np.add.reduceat(values, starts, axis=0, dtype=np.float64))
            held.clear()
            owners.clear()

    waiting = 0
    for i, text in enumerate(given):
        signs = signs_of(text)
        for low in range(0, len(signs), PIECE):
            part = grams_of(signs[low : low + PIECE]) if not low else grams_of(signs[low - ORDER + 1 : low + PIECE])[ORDER - 2 :]
            if len(part):
                held.append(part)
                owners.append(i)
                sizes[i] += len(part)
                waiting += len(part)
            if waiting >= PIECE:
                settle()
                waiting = 0
    settle()
    return sums, sizes


@dataclass
class LanguageModels:
    """The models of all languages, their joint table, and the calibration."""

    languages: list[str]
    models: list[KneserNey]
    joint: _Sorted | None
    #: Score by bin of evidence, and greatest accepted cross-entropy by language.
    scores: np.ndarray = field(default_factory=lambda: np.linspace(0.5, 1.0, EVIDENCE_BINS))
    limits: np.ndarray | None = None
    #: In place of models and joint table, where those are too large to be sent.
    tables: GramTables | None = None

    def sendable(self) -> LanguageModels:
        return replace(self, tables=None)

    def measured(self, rows: DataFrame) -> DataFrame:
        """The rows, with the sums of their text in its place where the models are tables."""
        return rows if self.tables is None else self.tables.measured(rows)

    def measures(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The entropies of a batch of ``measured``."""
        if "text" in batch.schema.names:
            return self.entropies(texts(batch))
        sizes = batch.column("size").to_numpy()
        return -np.asarray(batch.column("sums").flatten()).reshape(len(sizes), -1) / np.maximum(sizes, 1)[:, None], sizes

    @staticmethod
    def of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
        names = sorted(counts)
        models = [KneserNey(*counts[x]) for x in names]
        keys = np.unique(np.concatenate([counts[x][0] for x in names]))
        return LanguageModels(names, models, _Sorted(keys, np.stack([np.log(m.probability(keys, ORDER)) for m in models], axis=1).astype(np.float32)))

    def _log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        at, there = self.joint.find(grams)
        out = self.joint.values[at]
        if not there.all():
            rest, which = np.unique(grams[~there], return_inverse=True)
            out[~there] = np.stack([np.log(m.probability(rest, ORDER)) for m in self.models], axis=1)[which]
        return out

    def entropies(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text under each language, and its number of characters."""
        sums, sizes = sums_of(given, self._log_probabilities, len(self.models))
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def evidence_bin(self, entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bin of the log odds of the best language against the next."""
        if entropies.shape[1] < 2:
            return np.full(len(entropies), EVIDENCE_BINS - 1)
        low = np.partition(entropies, 1, axis=1)
        odds = (low[:, 1] - low[:, 0]) * sizes
        return np.minimum((np.log1p(odds) * 8).astype(np.int64), EVIDENCE_BINS - 1)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, calibrates, gram and n of all rows of text, lang and calibrates (false where that is missing)."""

    def run(batches):
        counts: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(which, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        for batch in (x for b in batches for x in slices(b)):
            by: dict[tuple[str, bool], list[np.ndarray]] = {}
            for text, *lang in zip(texts(batch), batch.column("lang").to_pylist(), batch.column("calibrates").to_pylist(), strict=True):
                by.setdefault(tuple(lang), []).append(grams_of(signs_of(text)))
            for lang, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                own = counts.setdefault(lang, [])
                own.append((keys, n))
                if len(own) >= 8:
                    counts[lang] = [merged(own)]
        for (lang, calibrates), own in counts.items():
            keys, n = merged(own)
            for low in range(0, len(keys), 50_000):
                k = keys[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array([calibrates] * len(k), pa.bool_()), pa.array(k.view(np.int64)), pa.array(n[low : low + 50_000])], names=["lang", "calibrates", "gram", "n"])

    flag = F.col("calibrates") if "calibrates" in rows.columns else F.lit(False).alias("calibrates")
    return in_arrow(rows.select("text", "lang", flag), run, "lang string, calibrates boolean, gram long, n long").groupBy("lang", "calibrates", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, sent_cells: int | None = None) -> LanguageModels | None:
    """Models from all rows of text and lang; None if there are none."""
    return models_of(materialise(gram_counts(rows).select("lang", "gram", "n"), "grams"), sent_cells)


def models_of(grams: DataFrame, sent_cells: int | None = None) -> LanguageModels | None:
    """Models from a table of lang, gram and n; None if it is empty."""
    sent_cells = sent_cells or SENT_CELLS
    sizes = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    languages = sorted(sizes)
    if sum(sizes.values()) * len(sizes) > sent_cells:
        return LanguageModels(languages, [], None, tables=GramTables(grams, languages, sent_cells))
    kept = grams.toArrow()
    langs = np.array(kept.column("lang").to_pylist())
    keys, n = kept.column("gram").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    return LanguageModels.of({lang: (keys[langs == lang], n[langs == lang]) for lang in languages})


def calibrate(models: LanguageModels, rows: DataFrame) -> LanguageModels:
    """Sets scores and limits by histograms over all rows of text and lang."""
    sent = rows.sparkSession.sparkContext.broadcast(models.sendable())
    measured = models.measured(rows.select("text", "lang"))

    def run(batches):
        m = sent.value
        place = {x: i for i, x in enumerate(m.languages)}
        right, entropy = np.zeros((EVIDENCE_BINS, 2), dtype=np.int64), np.zeros((len(place), ENTROPY_BINS), dtype=np.int64)
        for batch in (x for b in batches for x in (slices(b) if "text" in b.schema.names else [b])):
            h, sizes = m.measures(batch)
            truth = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()])
            use = sizes > 0
            np.add.at(right, (m.evidence_bin(h, sizes)[use], (h.argmin(axis=1) == truth)[use].astype(int)), 1)
            use &= truth >= 0
            own = h[use, truth[use]]
            np.add.at(entropy, (truth[use], np.minimum((own * BINS_A_NAT).astype(np.int64), ENTROPY_BINS - 1)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(right.size + entropy.size)), pa.array(np.concatenate([right.ravel(), entropy.ravel()]))], names=["i", "n"])

    sums = np.zeros(2 * EVIDENCE_BINS + len(models.languages) * ENTROPY_BINS)
    for r in in_arrow(measured, run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # as many rows as bins
        sums[r["i"]] = r["n"]
    right = sums[: 2 * EVIDENCE_BINS].reshape(-1, 2)
    raised = (right[:, 1] + 1) / (right.sum(axis=1) + 2)
    weight = right.sum(axis=1) + 1e-3
    blocks: list[list[float]] = []  # pooled until they rise: share, weight, bins
    for p, w in zip(raised, weight, strict=True):
        blocks.append([p, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            p2, w2, n2 = blocks.pop()
            p1, w1, n1 = blocks.pop()
            blocks.append([(p1 * w1 + p2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    models.scores = np.concatenate([np.full(int(n), p) for p, _, n in blocks])
    histogram = sums[2 * EVIDENCE_BINS :].reshape(-1, ENTROPY_BINS)
    above = np.cumsum(histogram[:, ::-1], axis=1)[:, ::-1]  # rows in each bin or a later one
    models.limits = np.array([np.flatnonzero(a > a[0] / REJECTED)[-1] + 1 if a[0] else ENTROPY_BINS for a in above]) / BINS_A_NAT
    return models


def predict(documents: DataFrame, models: LanguageModels | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for every row.

    ``rejected``: the text is further from its best language than almost all of that language's calibration rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(models and models.sendable())
    given = documents.select("doc_id", "text")
    given = models.measured(given) if models else given

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            m, n = sent.value, batch.num_rows
            names, scores, entropy, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, dtype=bool)
            if m is not None:
                h, sizes = m.measures(batch)
                best, some = h.argmin(axis=1), sizes > 0
                names = [m.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores = np.where(some, m.scores[m.evidence_bin(h, sizes)], 0.0)
                entropy = np.where(some, h.min(axis=1), np.nan)
                rejected = ~some | (entropy > m.limits[best]) if m.limits is not None else ~some
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

        return f

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_rows(given, make, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean", "text" if "text" in given.columns else "")


def learn(documents: DataFrame) -> LanguageModels | None:
    """Models and calibration from the rows of documents that aren't held out."""
    own = fold("doc_id", FOLDS)
    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").where(own != HELD_OUT).select("text", "lang", (own == CALIBRATION).alias("calibrates"))
    counted = materialise(gram_counts(rows), "grams")
    whole = models_of(materialise(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"))
    first = models_of(counted.where("NOT calibrates").select("lang", "gram", "n"))
    if whole and first:
        calibrate(first, rows.where("calibrates"))
        limits = dict(zip(first.languages, first.limits.tolist(), strict=True))
        whole.scores, whole.limits = first.scores, np.array([limits.get(x, ENTROPY_BINS / BINS_A_NAT) for x in whole.languages])
    return whole


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, learn(documents))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
