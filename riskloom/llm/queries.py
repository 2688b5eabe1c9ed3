"""One query for each operator over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    alignment, bpe, byte_model, cover_tree, hard_negatives, license_scan, minhash, mixing, quality_net, quality_rules,
    secret_scan, toxicity_net, url_filter)
from riskloom.llm.common import table


def op1_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.link_vectors(table(spark, folder, "embeddings"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_net.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, folder, "documents"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, folder, "documents"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents")).drop("times", "source")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_net.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.link_documents(table(spark, folder, "documents"))


def op11_byte_model(spark: SparkSession, folder: str) -> DataFrame:
    return byte_model.score_documents(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine_negatives(table(spark, folder, "embeddings"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f for f in (
        op1_cover_tree, op2_bpe, op3_quality_classifier, op4_url_filter, op5_quality_rules,
        op6_secret_scan, op7_source_mixing, op8_license_scan, op9_toxicity, op10_minhash,
        op11_byte_model, op12_hard_negatives, op13_alignment)
}
