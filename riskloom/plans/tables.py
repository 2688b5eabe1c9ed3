"""Logical tables over the parquet files of one data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K

def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's partitions, by no key, at every size alike.

    Text work is bound by CPU, and a file of a single row group is a single task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("msg_id"), F.col("text").alias("message"), "lang", "source")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(_documents(spark, folder))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "labels").select(
        F.col("doc_id").alias("msg_id"),
        F.when(F.col("toxic") == 1, K.FRAUDULENT).otherwise(K.LEGITIMATE).alias("label"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with a label; the join picks its strategy from table sizes.

    Joined before they are dealt, so that texts without a label are not moved for it.
    """
    return dealt(_documents(spark, folder).join(labels(spark, folder), "msg_id"))


def messages_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every message once, with all of its labels; null where it has none."""
    found = labels(spark, folder).groupBy("msg_id").agg(F.collect_list("label").alias("labels"))
    return dealt(_documents(spark, folder).join(found, "msg_id", "left"))


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Number of characters of every message; no text is moved for it."""
    return _documents(spark, folder).select("msg_id", F.length("message").alias("n_chars"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns; ``turn`` counts from 0 without gaps."""
    return dealt(read(spark, folder, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("turn"),
        F.col("role").alias("sender"), F.col("text"),
    ))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events")
