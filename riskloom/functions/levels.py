"""Ordered risk levels, recommendations and their combination."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as K


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small fixed dictionary as a CASE expression."""
    expr = None
    for name, value in table.items():
        expr = F.when(key == name, F.lit(value)) if expr is None else expr.when(
            key == name, F.lit(value))
    return expr.otherwise(F.lit(default))


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def score_level(score: Column) -> Column:
    return (
        F.when(score >= K.SCORE_HIGH, "high")
        .when(score >= K.SCORE_MEDIUM, "medium")
        .otherwise("low")
    )


def rank_of(level: Column) -> Column:
    """low 0, medium 1, high 2; anything else counts as low."""
    return lookup(level, {name: i for i, name in enumerate(K.LEVELS)}, 0)


def level_of(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(K.LEVELS)))


def higher(*levels: Column) -> Column:
    return level_of(F.greatest(*[rank_of(x) for x in levels]))


def label_level(label: Column, confidence: Column) -> Column:
    """Level implied by a predicted class; a missing confidence counts as sure."""
    unsure = lambda limit: F.coalesce(confidence < limit, F.lit(False))
    return (
        F.when(label == K.FRAUDULENT, F.when(unsure(0.6), "medium").otherwise("high"))
        .when(label == K.SUSPICIOUS, "medium")
        .otherwise(F.when(unsure(0.65), "medium").otherwise("low"))
    )


def verdict_level(verdict: Column, confidence: Column) -> Column:
    return (
        F.when(verdict == K.FRAUDULENT, F.when(confidence >= 0.7, "high").otherwise("medium"))
        .when(verdict == K.SUSPICIOUS, "medium")
        .otherwise("low")
    )


def recommendation(level: Column, fraud_type: Column | None = None) -> Column:
    base = lookup(level, K.RECOMMENDATION, K.RECOMMENDATION_DEFAULT)
    if fraud_type is None:
        return base
    return F.concat(base, lookup(fraud_type, K.FRAUD_TYPE_SUFFIX, ""))


def conversation_level(score: Column, config: dict | None = None) -> Column:
    cfg = {**K.CONVERSATION_DEFAULTS, **(config or {})}
    return (
        F.when(score >= cfg["critical_threshold"], "critical")
        .when(score >= cfg["high_threshold"], "high")
        .when(score >= cfg["medium_threshold"], "medium")
        .otherwise("low")
    )
