"""The corpus pipeline: documents to token ids, a stage an operator, each stage's table the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, mixing, quality, secrets, simhash
from ledgerline.llm.common import ensure_checkpoint_dir, table
from ledgerline.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.kept(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret in them is a mark, and n_chars counts anew."""
    return secrets.redact(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row a copy of each document taken, shuffled within shards."""
    return mixing.mix(docs, columns=COLUMNS).select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and whether the ids decode to the text, a row a copy."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.encode_checked(docs.select("doc_id", "source", "text"), path, pattern).select("doc_id", "source", "ids", "n_tokens", "round_trips")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: SQL expresses neither the classifier nor the fingerprints; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, read again, and deleted once the next one is there; the last of these stays, as the result reads it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
            if i:
                _drop(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
