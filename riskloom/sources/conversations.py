"""Conversations from JSON files and from plain text."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import is_blank, strip

_OBJECT = "text STRING, sender STRING, timestamp STRING"


def parse_json(df: DataFrame, value: str = "value", key: str = "conv_id") -> DataFrame:
    """Turns of JSON arrays whose items are strings or objects.

    Defaults: empty text, sender ``unknown``, no timestamp.
    """
    items = df.select(key, F.posexplode(F.from_json(value, "ARRAY<STRING>")).alias("turn", "_item"))
    is_object = F.col("_item").rlike(r"^\s*\{")
    item = F.when(is_object, F.from_json("_item", _OBJECT))
    return items.withColumn("_o", item).select(
        key, "turn",
        F.coalesce("_o.sender", F.lit("unknown")).alias("sender"),
        F.col("_o.timestamp").alias("ts"),
        F.when(is_object, F.coalesce("_o.text", F.lit(""))).otherwise(
            F.coalesce("_item", F.lit(""))).alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file; the file path identifies the conversation."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("conv_id"))
    return parse_json(files)


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: ~is_blank(line))


def parse_lines(df: DataFrame, text: str = "text", key: str = "conv_id") -> DataFrame:
    """Plain text: every non-blank line is a turn, numbered without gaps."""
    return df.select(
        key, F.posexplode(non_blank_lines(F.col(text))).alias("turn", "_line")
    ).select(key, "turn", F.lit("unknown").alias("sender"),
             strip(F.col("_line")).alias("text"))
