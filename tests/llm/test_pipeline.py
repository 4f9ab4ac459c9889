"""The pipeline's stages against plain Python, each on what its predecessor kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from spanloom.llm import bpe, decontaminate, quality, secrets, simhash
from tests.llm.test_operators import _groups

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage leaves, written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["input"] = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [r.asDict() for r in docs.collect()]
        if name != "bpe":
            assert docs.columns == COLUMNS
    return out


def _ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_quality(spark, kept):
    stats = quality.statistics(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    model = quality.fit(quality.training_rows(stats, spark.read.parquet(f"{FOLDER}/labels.parquet")), "y")
    assert _ids(kept["quality"]) == Counter(r["doc_id"] for r in kept["input"] if model.scores(np.array([quality.features(r["text"])]))[0] >= quality.CUT)


def test_near_dedup(kept):
    prints = defaultdict(list)
    for r in kept["quality"]:
        prints[simhash.fingerprint(r["text"])].append(r["doc_id"])
    assert _ids(kept["near_dedup"]) == Counter(set(_groups(prints, 2).values()))


def test_decontamination(spark, kept):
    items = [decontaminate.shingle_set(decontaminate.normalised_words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = []
    for r in kept["near_dedup"]:
        have = decontaminate.shingle_set(decontaminate.normalised_words(r["text"]))
        if not any(len(i & have) >= 0.8 * len(i) - 1e-9 for i in items if i):
            clean.append(r)
    assert _ids(kept["decontamination"]) == _ids(clean) and len(clean) < len(kept["near_dedup"])


def test_secrets(kept):
    owners = defaultdict(set)
    for r in kept["decontamination"]:
        for *_, value in secrets.base_spans(r["text"]) + secrets.wider_spans(r["text"]):
            owners[value].add(r["source"])
    expected = {}
    for r in kept["decontamination"]:
        spans = [(a, b) for a, b, k, v in secrets.base_spans(r["text"]) + secrets.wider_spans(r["text"]) if len(owners[v]) < secrets.EXAMPLE_OWNERS and (k < 3 or secrets.looks_random(v))]
        expected[r["doc_id"]] = secrets.redacted(r["text"], spans, "<secret>") if spans else r["text"]
    assert {r["doc_id"]: r["text"] for r in kept["secrets"]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secrets"] if "<secret>" in r["text"])


def test_tokens(kept):
    coder = bpe.TextEncoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in kept["secrets"]}
    assert _ids(kept["bpe"]) == _ids(kept["secrets"])
    for r in kept["bpe"]:
        assert r["exact"] and r["ids"] == np.frombuffer(coder.packed(texts[r["doc_id"]]), np.int32).tolist() and r["n_tokens"] == len(r["ids"])


def test_run(spark, kept):
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == _ids(kept["bpe"])


def test_stages_on_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
