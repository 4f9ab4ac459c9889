"""Operators that SQL can't state against plain Python written from their definitions alone."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from spanloom.llm import compression, decontaminate, langid, licenses, secrets, simhash
from tests.llm.test_operators import _frame, _prose, _words, docs, nothing, rows  # noqa: F401


def _fold(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


# op2


class _Dictionary:
    """Interpolated Kneser-Ney of order four over strings, by dictionaries."""

    def __init__(self, texts):
        self.counts = {4: Counter(g for t in texts for g in _four(t))}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.known = {}
        for n, own in self.counts.items():
            spread = Counter(own.values())
            discount = min(0.95, max(0.1, spread[1] / (spread[1] + 2 * spread[2]))) if spread[1] else 0.5
            heads = defaultdict(lambda: [0, 0])
            for g, c in own.items():
                heads[g[:-1]][0] += c
                heads[g[:-1]][1] += 1
            self.known[n] = discount, heads
        self.memo = {}

    def p(self, g):
        if not g:
            return 1 / (len(self.counts[1]) + 1)
        if g not in self.memo:
            discount, heads = self.known[len(g)]
            lower = self.p(g[1:])
            total, types = heads.get(g[:-1], (0, 0))
            self.memo[g] = (max(0, self.counts[len(g)][g] - discount) + discount * types * lower) / total if total else lower
        return self.memo[g]

    def entropy(self, text):
        grams = _four(text)
        return -sum(math.log(self.p(g)) for g in grams) / len(grams) if grams else None


def _four(text):
    letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    padded = f"   {letters} " if letters else ""
    return [padded[i : i + 4] for i in range(len(padded) - 3)]


def _models(rows, folds):
    own = defaultdict(list)
    for i, text, lang, _ in rows:
        if text is not None and lang is not None and _fold(i, 4) in folds:
            own[lang].append(text)
    return {lang: _Dictionary(texts) for lang, texts in own.items()}


def test_language_equals_dictionaries(docs, rows, spark):  # noqa: F811
    whole, first = _models(rows, (0, 1, 3)), _models(rows, (0, 1))
    limits = {}
    for lang, model in first.items():
        own = [model.entropy(t) for i, t, x, _ in rows if x == lang and t is not None and _fold(i, 4) == 3 and _four(t)]
        limits[lang] = (max(int(h * langid.BINS_A_NAT) for h in own) + 1) / langid.BINS_A_NAT
    foreign = ["Το κείμενο αυτό είναι ελληνικό", "这是一个中文文本", "это русский текст", "xqzwv kjqx zzxq wvkq jjxz"]
    asked = [*rows, *((900 + k, t, None, None) for k, t in enumerate(foreign))]
    models = langid.learn(docs)
    assert dict(zip(models.languages, models.limits.tolist(), strict=True)) == pytest.approx(limits)
    expected = []
    for i, text, *_ in asked:
        found = {lang: m.entropy(text) for lang, m in whole.items()}
        lang = min(sorted(found), key=found.get) if _four(text) else "und"
        h = found.get(lang)
        expected.append((str(i), lang, round(h, 3) if h is not None else None, h is None or h > limits[lang]))
    got = [(str(r["doc_id"]), r["lang_pred"], round(r["cross_entropy"], 3) if r["cross_entropy"] is not None else None, r["rejected"]) for r in langid.predict(_frame(spark, asked), models).collect()]
    near = lambda a, b: a[:2] == b[:2] and a[3] == b[3] and (a[2] == b[2] or abs(a[2] - b[2]) < 0.002)
    key = lambda r: (r[0], r[1], r[2] or 0)
    assert all(near(a, b) for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True))
    assert all(r[3] for r in got if r[0] in {"900", "901", "902", "903"})
    assert not any(r[3] for r in got if r[1] != "und" and any(r[0] == str(i) and _fold(i, 4) == 3 for i, *_ in rows))


def test_language_rejects_a_share(spark, monkeypatch):
    rng = random.Random(3)
    stems = ["ka", "lo", "mi", "ren", "tu", "sa"]
    made = [(i, _prose(rng, rng.randint(5, 40), stems), "aa", None) for i in range(800)]
    monkeypatch.setattr(langid, "REJECTED", 10)
    models = langid.learn(_frame(spark, made))
    first = langid.train(_frame(spark, [r for r in made if _fold(r[0], 4) in (0, 1)]))
    h, _ = first.entropies([r[1] for r in made if _fold(r[0], 4) == 3])
    assert 0.04 <= np.mean(h[:, 0] > models.limits[0]) <= 0.1


def test_language_predicts_nothing_for_no_rows(docs, nothing):  # noqa: F811
    assert langid.predict(nothing, langid.learn(docs)).count() == 0


# op10


def _verdict(text, bands):
    """kept, ratio and share of bad bytes of a text, by the definition."""
    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    data, words = (text or "").encode(), _words(text)

    def bad(part):
        if len(part) < compression.LEAST_BYTES:
            return False
        low, high = bands[math.floor(math.log2(len(part)) * compression.CLASSES + 1e-9)]
        return not low <= len(compress(part)) / len(part) <= high

    parts = [data[i : i + compression.CHUNK] for i in range(0, len(data), compression.CHUNK)] or [b""]
    if len(parts) > 1 and len(parts[-1]) < compression.CHUNK // 2:
        last = parts.pop()
        parts[-1] += last
    share = sum(len(p) for p in parts if bad(p)) / max(1, len(data))
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeat = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return not failed and not bad(data) and share <= compression.CHUNK_SHARE, share


def _bands(rows, good):
    """The bands by sorting the ratios of all good rows."""
    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    ratios = defaultdict(list)
    for i, text, *_ in rows:
        data = (text or "").encode()
        if len(data) >= compression.LEAST_BYTES and i is not None and _fold(i, 5) != 0:
            ratios[math.floor(math.log2(len(data)) * compression.CLASSES + 1e-9)] += [math.floor(len(compress(data)) / len(data) * compression.BINS)] * good.count(i)
    bands = compression.wide_bands()
    for k in bands:
        own, reach = [], 0
        while len(own) < compression.LEAST_ROWS and len(own) < sum(map(len, ratios.values())):
            own = sorted(r for j, rs in ratios.items() if abs(j - k) <= reach for r in rs)
            reach += 1
        skip = len(own) // compression.OUTSIDE
        bands[k] = own[skip] / compression.BINS - compression.MARGIN, (own[-1 - skip] + 1) / compression.BINS + compression.MARGIN
    return bands


def _noisy(rows):
    rng = random.Random(5)
    stems = ["ka", "lo", "mi", "ren", "os", "tu"]
    odd = [" ".join(rng.choices(["aa bb", "cc", "dd ee ff"], k=400)), "".join(map(chr, rng.choices(range(33, 127), k=9000))), " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(700))]
    half = _prose(rng, 900, stems)
    odd += [half + " " + odd[2], half + " " + odd[2][:1500], odd[2] + " " + half[:1500], half[:4096], half[:4097], half[:6143], half[:6144], half[:200]]
    return [*rows, *((500 + k, t, "aa", "src0") for k, t in enumerate(odd))]


@pytest.mark.parametrize("least", [8, 100])
def test_compression_verdicts(spark, rows, monkeypatch, least):  # noqa: F811
    monkeypatch.setattr(compression, "LEAST_ROWS", least)
    given = _noisy(rows)
    good = [i for i, *_ in given if i is not None and i < 120] + [3, 3, 7]
    labels = spark.createDataFrame([(i, 1, "clash") for i in good] + [(i, 0, "clash") for i in range(120, 140)] + [(None, 1, ""), (5, None, ""), (99999, 1, "")], "doc_id long, quality int, text string")
    bands = _bands(given, good)
    assert not set(bands.items()) & set(compression.wide_bands().items())  # every class is fitted
    expected = sorted((str(i), kept, round(share, 9)) for i, t, *_ in given for kept, share in [_verdict(t, bands)])
    assert sorted((str(r["doc_id"]), r["kept"], round(r["bad_chunk_share"], 9)) for r in compression.judge(_frame(spark, given), labels).collect()) == expected
    assert {k for _, k, _ in expected} == {True, False}


def test_compression_of_nothing(spark, nothing):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert compression.judge(nothing, labels).count() == 0 and compression.judge(nothing).count() == 0


def test_compression_cut():
    for n in (0, 1, 4096, 4097, 6143, 6144, 8192, 10_239, 10_240, 50_000):
        data = bytes(i % 251 for i in range(n))
        parts = compression.cut(data)
        assert b"".join(parts) == (data if n > compression.CHUNK else b"")
        assert all(compression.CHUNK // 2 <= len(p) < 1.5 * compression.CHUNK for p in parts)


# op4


@pytest.mark.parametrize("full", [1, 5, 256])
def test_near_pairs_of_full_cells(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(full)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ (1 << b) for b in range(0, 64, 3)} | {base ^ (1 << a) ^ (1 << b) for a, b in (rng.sample(range(64), 2) for _ in range(40))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ordered = sorted(prints, key=signed)
    got = [(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()]
    assert Counter(got) == Counter((signed(a), signed(b)) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 2)


def test_near_dedup_hands_columns_on(spark):
    made = [(1, "a b c d", 5, 6, "x"), (2, "a b c d", 7, 8, "y"), (3, "quite another text here", 9, 10, "z"), (None, "a b c d", 1, 2, "n")]
    df = spark.createDataFrame(made, "doc_id long, text string, row long, __row long, fp string")
    assert sorted(map(tuple, simhash.one_of_each_group(df).collect())) == [made[0], made[2]]


# op1


WEB = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def test_web_tokens_equal_the_pattern():
    rng = random.Random(1)
    part = lambda: rng.choice(["", "eyJ", "x", "eyJeyJ"]) + "".join(rng.choices("eyJab0-_", k=rng.randint(0, 14)))
    met = 0
    for _ in range(10_000):
        text = "".join(part() + rng.choice([".", ".", ".", " ", ".."]) for _ in range(rng.randint(1, 9)))
        expected = [m.span() for m in WEB.finditer(text)]
        met += len(expected)
        assert secrets.web_tokens(text) == expected
    assert met > 300
    began = time.perf_counter()
    for text in ("eyJ" * 1_000_000, "eyJaaaaaaaa." * 200_000, "token" * 300_000, "-----BEGIN " * 50_000, "AKIA" * 200_000, "a" * 3_000_000 + "é"):
        assert secrets.base_spans(text) is not None and secrets.wider_spans(text) is not None
    assert time.perf_counter() - began < 60


def _entropy(v):
    return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())


def _secret_spans(text):
    """(start, kind, end, value) of all kinds but private keys, by plain patterns."""
    found = []
    for kind, pattern, least in (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        ("access", "(AKIA[A-Z0-9]+)", 16),
        ("hex", "([0-9a-f]+)", 32),
        ("provider", "(gh[pousr]_[A-Za-z0-9]{36,}|AIza[A-Za-z0-9_-]{35})", 0),
        ("webtoken", f"({WEB.pattern})", 0),
    ):
        found += [(m.start(), kind, m.end(), m[1]) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        v = m[0]
        if len(v) >= 32 and v.upper() != v and v.lower() != v and re.search(r"\d", v) and _entropy(v) >= secrets.DENSE_BITS:
            found.append((m.start(), "dense", m.end(), v))
    return found


def test_secret_spans_by_ownership(spark):
    rng = random.Random(11)
    make = lambda k: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=k))
    token = lambda: rng.choice([f"ghp_{make(36)}", f"eyJ{make(12)}.eyJ{make(20)}.{make(16)}", f"{make(20)}/{make(20)}", f'secret: "{make(12)}"', hashlib.md5(make(4).encode()).hexdigest(), f"AIza{make(35)}", f"token={make(3)}example{make(3)}"])
    copied, both, own = [token() for _ in range(6)], [token() for _ in range(4)], [token() for _ in range(8)]
    rows_ = []
    for i in range(90):
        parts = [f"words {i} \U0001f600"]
        if i % 2:
            parts.append(rng.choice(copied))
        if i % 3 == 0:
            parts.append(both[i % 4] if i % 5 < 2 else both[0])
        if i % 5 == 0:
            parts += [own[i % 8], token()]
        rows_.append((i, " and ".join(parts), None, f"o{i % 2}" if i % 3 == 0 else f"o{i % 7}"))
    rows_ += [(200, None, None, None), (201, "", None, None), rows_[5]]
    holders = defaultdict(set)
    for i, text, _, owner in rows_:
        for *_, v in _secret_spans(text or ""):
            holders[v].add((owner, i))
    names = {k: n for n, k in enumerate(secrets.KINDS)}
    expected = Counter()
    for i, text, _, _ in rows_:
        listed, live, example = [], 0, 0
        for start, kind, end, v in sorted(_secret_spans(text or ""), key=lambda s: (s[0], names[s[1]])):
            owners = {o for o, _ in holders[v]}
            wide = len(owners) >= 3 or len(owners) == 2 and len(holders[v]) >= 10
            lively = not wide and _entropy(v) >= 3 and "example" not in v.lower() and not secrets._PLACEHOLDER.search(v)
            live, example = live + lively, example + wide
            if names[kind] < 3 or lively:
                listed.append(f"{kind}:{start}:{end}")
        expected[i, ",".join(listed), live, example] += 1
    spark_rows = _frame(spark, rows_)
    judged = secrets.judged_spans(spark_rows, F.col("source"), F.col("doc_id"))
    got = Counter()
    for r in judged.collect():
        kept = [s for s in r["found"] if s["kind"] < 3 or s["verdict"] == "live"]
        got[r["doc_id"], ",".join(f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in kept), sum(s["verdict"] == "live" for s in r["found"]), sum(s["verdict"] == "example" for s in r["found"])] += 1
    assert got == expected and sum(k[2] for k in got) > 5 and sum(k[3] for k in got) > 20


@pytest.mark.parametrize("sent", [100, 0])
def test_redaction_of_odd_columns(spark, sent):
    given = [(i, f"x token = sharedvalue{'Q7' * 4} y", f"o{i}", 1, 2, 3, "e") for i in range(3)] + [(None, "secret: Zx81kqPw93", None, 4, 5, 6, None)]
    df = spark.createDataFrame(given, "doc_id int, text string, source string, key long, __key int, n_chars int, examples string")
    out = secrets.redact_live(df, F.col("source"), F.col("doc_id"), sent_examples=sent)
    assert out.schema == df.schema
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [*given[:3], (None, "<secret>", None, 4, 5, 8, None)]))
    assert secrets.judged_spans(df.limit(0), F.col("source"), F.col("doc_id")).count() == 0
    assert secrets.redact_live(df.limit(0), F.col("source"), F.col("doc_id"), sent_examples=sent).count() == 0


# op5


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,0)", "bigint"])
def test_items_of_any_id(spark, kind):
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[i : i + 6 + 2**i])) for i in range(8)] + [(None, " ".join(words[50:70]))]
    made = [(1, " ".join(words)), (2, " ".join(words[:30])), (3, " ".join(words[::-1])), (4, None)]
    benchmark = spark.createDataFrame(items, "item_id int, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    docs_ = spark.createDataFrame(made, "doc_id int, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    got = decontaminate.contained_items(docs_, benchmark)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    expected = Counter((str(d), str(i)) for d, t in made for i, u in items if t and len(sets(u) & sets(t)) >= 0.8 * len(sets(u)))
    assert Counter((str(r["doc_id"]), str(r["item_id"])) for r in got.collect()) == expected and sum(expected.values()) > 10
    assert decontaminate.contained_items(docs_.limit(0), benchmark).count() == 0


# op9


def test_whole_license_texts(spark):
    """Each whole text, in long documents and with a tenth of its words changed here and there, against exact containment."""
    rng = random.Random(9)
    whole = [t for t in licenses.TEMPLATES if t[1] == "text"]
    assert len(whole) == 7
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    made = [(i, f"{prose(rng.randint(0, 900))} {t[2]} {prose(300)}") for i, t in enumerate(whole)]
    for i, t in enumerate(whole):
        words = t[2].split()
        for at in rng.sample(range(len(words)), len(words) // 60):
            words[at] = "changed"
        made.append((100 + i, prose(500) + " " + " ".join(words)))
    made.append((200, prose(2000)))
    got = licenses.license_matches(spark.createDataFrame(made, "doc_id int, text string")).where("form = 'text'").collect()
    found = {(r["doc_id"], r["license"]): r["containment"] for r in got}
    for i, text in made:
        have = set(licenses.shingles_of(licenses.words_of(text)))
        for k, t in enumerate(whole):
            want = licenses.shingles_of(licenses.words_of(t[2]))
            share = sum(s in have for s in want) / len(want)
            if i % 100 == k and i < 200:
                assert (share >= 0.8) == ((i, t[0]) in found)
                assert share < 0.8 or found[i, t[0]] == pytest.approx(share)
    assert not any(i == 200 for i, _ in found) and sum((i, t[0]) in found for i, t in enumerate(whole)) == 7
