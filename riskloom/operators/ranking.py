"""Ranks and cut-offs of large groups without sorting a group in one task.

A group is cut into buckets of its order key.  Bucket counts are tiny, so their
running totals can be computed per group; only rows inside one bucket are ever
sorted together.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_MODULUS = 2_147_483_647
_BUCKET_WIDTH = 1 << 20


def stable_hash(key: Column, seed: int = 0) -> Column:
    """Arithmetic hash in [0, 2^31 - 1): the same in every engine, for keys of any size."""
    small = F.pmod(key.cast("bigint"), F.lit(HASH_MODULUS))
    return F.pmod(small * 48271 + seed * 69621, F.lit(HASH_MODULUS))


def sample_cutoffs(
    rows: DataFrame, group: str, key: str, quota: Column, seed: int,
) -> DataFrame:
    """Per group, the (hash, key) of the last row of a hash-ordered sample.

    ``quota`` is the sample size as an expression over ``n`` (rows of the group).
    Returns one row per group: ``group, n, quota, cut_hash, cut_key``.
    """
    hashed = rows.select(group, key, stable_hash(F.col(key), seed).alias("_h")).withColumn(
        "_bucket", F.floor(F.col("_h") / _BUCKET_WIDTH))
    by_bucket = hashed.groupBy(group, "_bucket").agg(F.count("*").alias("_in"))
    running = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    edges = (
        by_bucket
        .withColumn("_before", F.coalesce(F.sum("_in").over(running), F.lit(0)))
        .withColumn("n", F.sum("_in").over(whole))
        .withColumn("quota", quota.cast("bigint"))
        .filter((F.col("_before") < F.col("quota"))
                & (F.col("_before") + F.col("_in") >= F.col("quota")))
    )
    order = Window.partitionBy(group, "_bucket").orderBy("_h", key)
    return (
        hashed.join(F.broadcast(edges), [group, "_bucket"])
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") == F.col("quota") - F.col("_before"))
        .select(group, "n", "quota", F.col("_h").alias("cut_hash"), F.col(key).alias("cut_key"))
    )


def hash_sample(
    rows: DataFrame, group: str, key: str, quota: Column, seed: int, flag: str,
) -> DataFrame:
    """Add the boolean ``flag``: row belongs to the exact stratified sample.

    Groups are few (classes); the table of cut-offs has one row for each.
    """
    cuts = sample_cutoffs(rows, group, key, quota, seed).select(group, "cut_hash", "cut_key")
    h = stable_hash(F.col(key), seed)
    return (
        rows.join(F.broadcast(cuts), group, "left")
        .withColumn(flag, F.coalesce(
            (h < F.col("cut_hash"))
            | ((h == F.col("cut_hash")) & (F.col(key) <= F.col("cut_key"))), F.lit(False)))
        .drop("cut_hash", "cut_key")
    )


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The optimizer limits each group to ``k`` rows in every map task before the
    shuffle, so a hot group does not meet in one task.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
