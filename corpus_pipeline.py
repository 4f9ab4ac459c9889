"""Corpus pipeline over ``documents``: good, unique, uncontaminated texts without live secrets, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, quality, secrets, simhash
from spanloom.llm.common import table
from spanloom.plans.scratch import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (7): rows below the cut go.

    Null and empty texts are scored like others, long ones whole; equal rows fare alike; ties with the cut stay. With one class of
    label or none, all rows have one score: 0 if only bad ones are known, else enough to stay. No rows give none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (4): the row of least doc_id stays for each group.

    Null, empty and wordless texts have fingerprint zero and are one group; a null doc_id comes after all others; rows that repeat id and
    text are one row. Long texts count whole. No rows give none.
    """
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (5): rows that contain a test item go.

    Null and empty texts contain nothing and stay, null and empty items are in nothing; repeated rows fare alike; containment equal to
    the threshold counts. An empty benchmark lets all rows stay; no rows give none.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (1): secrets are replaced by a mark, but for examples that many sources share.

    All rows stay, repeated ones too. Null texts stay null, texts without a secret stay as they are, and n_chars follows a changed text. A
    null source or doc_id is an owner or a repository like another. No rows give none.
    """
    return secrets.redact_live(docs, F.col("source"), F.col("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (3): token ids of each text, and whether decoding them gives the text again.

    One row for each; a null or empty text has no ids and is exact. Long texts are encoded whole. No rows give none.
    """
    path = public_tokenizers.path(bpe.VOCABULARY)
    own = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    both = bpe.encode_texts(own, path, decoded="decoded")
    exact = (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact")
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", exact)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No stage can be stated in SQL; tests/llm holds the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with what each leaves written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
