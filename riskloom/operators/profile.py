"""Exploratory aggregates of a labelled message table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.features import word_count
from riskloom.functions.words import contains_any
from riskloom.operators.ranking import top_per_group


def class_shares(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # a handful of classes
    return counts.select(label, "n", F.round(F.col("n") * 100.0 / whole, 2).alias("percent"))


def length_summary(df: DataFrame, label: str = "label", text: str = "message") -> DataFrame:
    """describe() of lengths and word counts per class.

    Exact percentiles keep counts of distinct lengths, which combine on the map
    side.
    """
    sized = df.select(label, F.explode(F.array(
        F.struct(F.lit("msg_length").alias("measure"), F.length(text).alias("value")),
        F.struct(F.lit("word_count").alias("measure"), word_count(F.col(text)).alias("value")),
    )).alias("m")).select(label, "m.*")
    quartile = lambda p: F.round(F.percentile("value", p), 1)
    return sized.groupBy(label, "measure").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("mean"),
        F.round(F.stddev_samp("value"), 1).alias("std"), F.min("value").alias("min"),
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"),
        F.max("value").alias("max"))


def length_histogram(df: DataFrame, bins: int = 40, label: str = "label",
                     text: str = "message") -> DataFrame:
    """Equal-width bins per class between the shortest and the longest message."""
    sized = df.select(label, F.length(text).alias("_len"))
    lengths = sized.groupBy(label, "_len").agg(F.count("*").alias("_n"))
    edges = lengths.groupBy(label).agg(F.min("_len").alias("_lo"), F.max("_len").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    number = F.when(width > 0, F.least(
        F.floor((F.col("_len") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return lengths.join(F.broadcast(edges), label).groupBy(label, number.cast("int").alias("bin")).agg(
        F.sum("_n").alias("n"), F.round(F.min(F.col("_lo") + number * width), 3).alias("bin_start"))


def signal_prevalence(df: DataFrame, label: str = "label", text: str = "message") -> DataFrame:
    low = df.select(label, text, F.lower(text).alias("_low"))
    flags = {
        "has_urgency": contains_any("_low", K.URGENCY_WORDS),
        "has_credentials": contains_any("_low", K.CREDENTIAL_WORDS),
        "has_prize": contains_any("_low", K.PRIZE_WORDS),
        "has_money_words": contains_any("_low", K.MONEY_WORDS),
        "has_url": F.col(text).rlike(K.PROFILE_URL),
    }
    return low.groupBy(label).agg(*[
        F.round(F.avg(c.cast("int")), 3).alias(n) for n, c in flags.items()])


def top_words(df: DataFrame, k: int = 15, label: str = "label", text: str = "message") -> DataFrame:
    """Most frequent words per class; (class, word) counts combine on the map side."""
    tokens = df.select(label, F.explode(F.regexp_extract_all(
        F.lower(text), F.lit(K.TERM), F.lit(0))).alias("word"))
    counts = tokens.groupBy(label, "word").agg(F.count("*").alias("n"))
    return top_per_group(counts, [label], [F.desc("n"), F.col("word")], k)


def cleaning_effect(df: DataFrame, text: str = "message", cleaned: str = "clean") -> DataFrame:
    """Sizes before and after cleaning, and how many rows become empty."""
    return df.agg(
        F.count("*").alias("n_before"), F.sum((F.col(cleaned) != "").cast("bigint")).alias("n_after"),
        F.sum((F.col(cleaned) == "").cast("bigint")).alias("n_removed"),
        F.round(F.avg(F.length(text)), 4).alias("mean_length_before"),
        F.round(F.avg(F.length(cleaned)), 4).alias("mean_length_after"),
        F.round(F.avg(word_count(F.col(text))), 4).alias("mean_words_before"),
        F.round(F.avg(word_count(F.col(cleaned))), 4).alias("mean_words_after"))
