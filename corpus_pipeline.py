"""The corpus pipeline: five of the training-data operators, one after another, each on all that the one before kept.

Language ID drops documents whose language isn't identified and writes the language found to `lang`; near-dedup
keeps the smallest id of each group (five-word shingles, 0.8); decontamination drops documents that hold a benchmark
item; the secret scan masks secrets in `text`; the last stage encodes what is left.

Defined results: a null text is an empty one, which has no language, so its document goes; rows without an id pass the
first three stages and are encoded; rows that repeat an id share one fate (their links and leaks are those of all
their texts) and stay rows of their own; no rows give no rows. All stages but the last keep every column of their
input under its own name; the last returns doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.common import read_table, shared_dir, small_batches
from sonoframe.llm.decontamination import decontaminate
from sonoframe.llm.language_id import keep_identified
from sonoframe.llm.near_dedup import drop_near_duplicates
from sonoframe.llm.secret_scan import labelled_samples, redact
from sonoframe.llm.sentencepiece_bpe import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, that language as lang."""
    small_batches(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    small_batches(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in text replaced by a mark and n_chars to match."""
    small_batches(spark)
    return redact(docs, labelled_samples(read_table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of every document."""
    small_batches(spark)
    return encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", encoding),
]

#: SQL can't express the trained and hashed stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
