"""Token counts, the Merkle manifest and the divergence audit against plain Python, on odd rows and on generated ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import divergence, manifest, tokencounts

ROWS = "doc_id long, source string, lang string, n_chars long, text string, word string, tree string, place long, term string, n string"
ODD = [
    "", None, "a b c d", "x<|endoftext|>y <|startoftext|><|endoftext|", "Å ́e é", "\x1c\x1d a\x1eb\x85c d", "don't WE'LL 's's 'T",
    "İstanbul ΣΑΣ ß ﬁ", "日本語 テスト 한국어 각", "a" * 5000, "1234567890 !!!???", "\U0001f600‍\U0001f467 x", "  　 ", "Foo BAR foo " * 3000,
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "t", 7, "q", "n") for r in rows], ROWS)


def odd_rows():
    own = [(i, None if i % 3 == 0 else f"s{i % 2}", None if i % 4 == 0 else "en", len(t or ""), t) for i, t in enumerate(ODD)]
    return [*own, own[2], own[2], (None, "s0", "en", None, "No Id"), (None, None, None, None, None)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("head", [tokencounts.HEAD, 20, 1])
def test_token_counts_are_the_librarys(spark, name, head):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = odd_rows()
    expected = sorted((str(r[0]), len((r[4] or "").encode()), len(library.encode(r[4] or "", add_special_tokens=False).ids)) for r in rows)
    got = tokencounts.token_counts(frame(spark, rows), path, head).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected


def test_token_counts_with_a_small_memory(spark, monkeypatch):
    """A task that forgets its pre-tokens after each slice counts the same."""
    path = public_tokenizers.path(tokencounts.VOCABULARY)
    rng = random.Random(5)
    known = tokencounts._Frequencies(tokencounts.Splitter(path))
    monkeypatch.setattr(tokencounts, "REMEMBERED", 10)
    for _ in range(5):
        rows = [" ".join(rng.choice(["Word", "l'eau", "x1", "ein-zwei", "naïve y"]) + str(rng.randrange(9)) for _ in range(rng.randrange(30))) for _ in range(20)]
        doc, word, times = known.pairs(rows)
        names = list(known.words)
        got = defaultdict(Counter)
        for d, w, n in zip(doc.tolist(), word.tolist(), times.tolist(), strict=True):
            got[d][names[w]] += n
        assert [got[i] for i in range(len(rows))] == [Counter(known.splitter.of(r)) for r in rows]


def test_token_counts_of_nothing(spark):
    assert tokencounts.token_counts(frame(spark, []), public_tokenizers.path(tokencounts.VOCABULARY)).collect() == []


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    doc_id, source, lang, n_chars, text = r
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes):
    """Root of a list of digests, and for each the siblings of each level, as pairs of lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, path in enumerate(paths):
            run, k = runs[at[i] // 16], at[i] % 16
            path.append((run[:k], run[k + 1 :]))
            at[i] //= 16
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[(r[1] is not None, (r[1] or "").encode())].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(by)
    grown = {n: grow([x[2] for x in sorted(by[n], key=lambda x: x[:3])]) for n in names}
    root, tops = grow([grown[n][0] for n in names])
    out = []
    for n, top in zip(names, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(by[n], key=lambda x: x[:3]), grown[n][1], strict=True):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = plain_leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for before, after in path + top:
                now = h(*before, now, *after)
            proof = h(*[x for b, a in path + top for x in b + a])
            out.append((r[0], leaf, grown[n][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def generated(n, sources, seed=3):
    rng = random.Random(seed)
    return [(i * 7 % 100_003, rng.choice(sources), "en", 3, rng.choice(["Abc", "abc", "ÉA", None]) ) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [odd_rows(), generated(1, [None]), generated(16, ["a"]), generated(17, ["a"]), generated(256, ["a"]), generated(257, ["a"]), generated(4100, ["hot"] * 30 + ["b", None, ""]), generated(300, [f"s{i}" for i in range(290)])],
    ids=["odd", "one", "16", "17", "256", "257", "two rounds", "many sources"],
)
def test_manifest(spark, rows):
    got = manifest.manifest(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_manifest(rows)


def test_manifest_with_small_blocks(spark, monkeypatch):
    """Three rounds of traversals give the tree of one."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rows = generated(700, ["hot"] * 9 + ["b"])
    assert [manifest.height_of(n) for n in (1, 2, 16, 17)] == [0, 1, 1, 1]
    # Workers import the module anew, so the rounds are followed here, by the functions that they call.
    nodes = [plain_leaf(r) for r in rows if r[1] == "hot"]
    root, paths = grow(nodes)
    got = [[] for _ in nodes]
    assert manifest._unwind(nodes, 0, 3, got) == root
    assert [[("".join(b), "".join(a)) for b, a in p] for p in paths] == got


def test_whole_paths(spark):
    rows = [(("a" if i < 600 else "b"), i, h(str(i))) for i in range(620)]
    nodes = spark.createDataFrame([(t, i, d) for t, i, d in rows], "tree string, key long, digest string")
    got = {(r.tree, r.place): (r.root, [(p.before, p.after) for p in r.path]) for r in manifest.paths(manifest.placed(nodes, "key")).collect()}
    for tree in "ab":
        own = [d for t, _, d in rows if t == tree]
        root, paths = grow(own)
        assert [got[tree, i] for i in range(len(own))] == [(root, [("".join(b), "".join(a)) for b, a in p]) for p in paths]


def test_manifest_of_nothing(spark):
    assert manifest.manifest(frame(spark, [])).collect() == []


def plain_audit(rows):
    by, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, source, lang, _, text in rows:
        source, lang = source or "", lang or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        by[lang, source].update(found)
        docs[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        terms = sorted(t for t, n in docs[lang].items() if n >= 30)
        whole = Counter()
        for s in sources:
            whole.update({t: by[lang, s][t] for t in terms})
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(terms)) for t in terms})(sum(c[t] for t in terms))
        q, p = share(whole), {s: share(by[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in terms)) for o in sources if o != s]
            lead = [(t, p[s][t] - q[t]) for t in terms if by[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", lead, 50)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def speech(seed, n, sources):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "déjà", "日本", "x-ray", "École", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]]
    return [(i, rng.choice(sources), rng.choice(["en", "en", "en", "fr", None]), 1, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [divergence.SHARD_ROWS, 100])
@pytest.mark.parametrize("sources", [["a", "b", None, "é"], ["a"] * 5 + [f"s{i}" for i in range(150)], ["one"]], ids=["few", "three blocks", "one"])
def test_audit(spark, shard_rows, sources):
    rows = [*speech(11, 900, sources), *odd_rows(), (5, "lonely", "xx", 1, "once"), (6, "other", "xx", 1, None)]
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows), shard_rows).collect()) == plain_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_counting_in_parts(spark, monkeypatch):
    """Counts that are handed on whenever there are a few add up to the same."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 50)
    rows = speech(2, 200, ["a", "b"])
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[1] for r in rows], "text": [r[4] for r in rows]})
    got, docs = Counter(), Counter()
    for part in divergence._counted(iter([batch])):
        for r in part.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    expected, in_docs = Counter(), Counter()
    for _, s, lang, _, t in rows:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(divergence.TERM, t)]
        expected.update((lang or "", s, x) for x in own)
        in_docs.update((lang or "", s, x) for x in set(own))
    assert got == expected and docs == in_docs
