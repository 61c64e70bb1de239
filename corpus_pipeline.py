"""Training-data pipeline over `documents`: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage gets what its predecessor kept, as a written table, and all but the last return the
columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm.bpe import digests
from kinloom.llm.common import lowered, pick, read, shared_folder, stored
from kinloom.llm.decontaminate import decontaminate
from kinloom.llm.near_copies import drop_near_copies
from kinloom.llm.quality import drop_low_quality
from kinloom.llm.secret_scan import redact
from kinloom.llm.simhash import drop_near_duplicates
from kinloom.session import discard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality model rejects."""
    lowered(spark)
    return drop_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by fingerprints, and of what is left by five-word shingles."""
    lowered(spark)
    return drop_near_copies(stored(drop_near_duplicates(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window."""
    lowered(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of every document."""
    lowered(spark)
    return digests(pick(docs, doc_id="doc_id", text="text"), chunks=50_000)  # a worker keeps what it remembers beside the other stages' needs


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: No SQL: fingerprints, latent-class estimation and BPE can't be expressed; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written to the shared folder and read again.

    What a stage has written is deleted when its successor has written; the last goes with the application."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
