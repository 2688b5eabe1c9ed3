"""Label encoding, stratified split, class weights, folds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.ranking import hash_sample, stable_hash


def encode_labels(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Alphabetical class numbers; the table of classes is tiny."""
    classes = df.select(label).distinct().agg(
        F.sort_array(F.collect_list(label))).scalar()
    return df.withColumn(out, (F.array_position(classes, F.col(label)) - 1).cast("int"))


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "msg_id",
    test_size: float = K.TEST_SIZE, seed: int = K.SEED, flag: str = "is_test",
) -> DataFrame:
    """Mark exactly ``test_size`` of every class as test rows."""
    return hash_sample(df, label, key, F.floor(F.col("n") * test_size + 0.5), seed, flag)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` of every class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_class"))
    totals = counts.agg(F.struct(F.sum("n_class").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n_class",
        (F.col("_t.n") / (F.col("_t.k") * F.col("n_class"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)


def fold(key: Column, folds: int, seed: int = K.SEED) -> Column:
    """Fold number by hash; with large classes every fold has the class mix."""
    return F.pmod(stable_hash(key, seed), F.lit(folds)).cast("int")
