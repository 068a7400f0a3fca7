"""The corpus pipeline: five stages, each an operator of ``kpiscope.llm`` over all that the
stage before kept. All stages but the last return the columns of ``documents``.

Each stage takes columns of any names besides ``doc_id`` and ``text`` and leaves them as they are (the
last returns its own), reads whole texts of any length, and turns an empty table into an empty one.
"""

from __future__ import annotations

from kpiscope.llm import bpe_segment, pii_crf, quality_cnn, simhash_tiles, suffix_decontam
from kpiscope.llm.common import new_path, table
from kpiscope.llm.queries import QUALITY_THRESHOLD, vocabulary
from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts are scored as empty ones; equal texts score the same, so repeats stay or go together.
    A score of exactly the threshold stays. Without labels, or with good ones only, all stay.
    """
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles or more, directly or through
    others, the one of the smallest doc_id stays.

    Texts without words (null and empty ones too) are one group; texts of fewer than five words
    are one shingle. Rows without a doc_id stay, and so do equal rows of the smallest doc_id.
    """
    return simhash_tiles.keep_one(docs, words=5, radius=24, min_similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words and more are cut out; documents that are mostly such
    passages (over half of their words) go.

    Null texts and texts without words have no passages and stay as they are; repeats each get
    the same cut. An empty benchmark changes nothing.
    """
    return suffix_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. No row goes; null texts stay null, and empty and
    equal texts stay so."""
    return pii_crf.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the texts' token ids, and the texts decoded from them.
    A null text is encoded as an empty one; each row, repeated or not, gives a row."""
    return bpe_segment.encode_documents(docs, vocabulary(), ids="ids", decoded="decoded")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can express none of the classifier, fingerprints, field and merges; tests compare with
#: brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
