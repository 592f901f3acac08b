"""The queries opN_<name>: each operator over its whole table with production parameters; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, hamming, mixing, ogg, oracles, ppm, quality, secrets, simhash, suffixes, urls
from ledgerline.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return simhash.classes(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents under the trie and under the base."""
    return ppm.score(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Ogg, read back and described."""
    return ogg.digests(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, toxicity and the decision for every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 100 bytes that start earlier."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every twentieth row, by the signs of the embeddings."""
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_ppm_score": op3_ppm_score,
    "op4_url_filter": op4_url_filter,
    "op5_ogg_media": op5_ogg_media,
    "op6_secret_scan": op6_secret_scan,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_topk": op10_exact_topk,
}

ORACLES: dict[str, str] = oracles.ORACLES
