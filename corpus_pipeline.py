"""Documents to tokens in five stages; each is written and read again as the next one's input.

All stages take null ids, null sources and repeated rows as rows of their own and give an
empty table for an empty one. Null and empty texts fail the quality rules; for the later
stages, on their own, they hold no shingles, no secrets, no words and no tokens.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import bpe, minhash, mixing, quality_rules, secret_scan
from riskloom.llm.common import table
from riskloom.session import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines; repeated rows stay or go together."""
    return quality_rules.keep_documents(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 80 percent); empty texts are copies of nothing."""
    return minhash.keep_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; null texts stay null."""
    return secret_scan.mask_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice."""
    return mixing.take_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every taken document; null texts count as empty."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", keep_good), ("near-dedup", keep_first), ("secret scan", mask_secrets),
          ("source mixing", mix_sources), ("byte-pair encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
