"""Rule signals of a raw message: twelve predicates, points, level, signal list."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.levels import score_level
from riskloom.functions.text import (
    has_phone,
    is_blank,
    may_hold_email,
    may_hold_money,
    may_hold_url,
)
from riskloom.functions.words import contains_any

SIGNALS = list(K.SIGNAL_POINTS)


def url_count(text: Column) -> Column:
    return F.when(
        may_hold_url(text), F.regexp_count(text, F.lit(K.RULE_URL))).otherwise(0)


def has_email(text: Column) -> Column:
    return may_hold_email(text) & text.rlike(K.EMAIL)


def has_money(text: Column) -> Column:
    return may_hold_money(text, K.RULE_MONEY_MARKS) & text.rlike(K.RULE_MONEY)


def exclamations(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def with_flags(df: DataFrame, text: str = "message", lowered: str | None = None) -> DataFrame:
    """Add ``n_urls`` and one boolean ``sig_*`` column per signal.

    ``lowered`` names an existing lower-cased copy of the text, if there is one.
    """
    t = F.col(text)
    low_name = lowered or "_lowered"
    if lowered is None:
        df = df.withColumn(low_name, F.lower(t))
    df = df.withColumns({
        "n_urls": url_count(t),
        "sig_phone": has_phone(t),
        "sig_email": has_email(t),
        "sig_money": has_money(t),
        "sig_urgency": contains_any(low_name, K.URGENCY_WORDS),
        "sig_block": contains_any(low_name, K.ACCOUNT_BLOCK_WORDS),
        "sig_prize": contains_any(low_name, K.PRIZE_WORDS),
        "sig_transfer": contains_any(low_name, K.TRANSFER_WORDS),
        "sig_credential": contains_any(low_name, K.CREDENTIAL_WORDS),
        "sig_pressure": contains_any(low_name, K.PRESSURE_WORDS),
        "_money_hit": contains_any(low_name, K.MONEY_WORDS),
        "sig_exclamation": exclamations(t) >= K.EXCLAMATION_MIN,
        "_blank": is_blank(t),
    })
    df = df.withColumns({
        "sig_url": F.col("n_urls") > 0,
        "sig_money_words": F.col("_money_hit") & ~F.col("sig_money"),
    })
    on = {f"sig_{s}": F.coalesce(F.col(f"sig_{s}") & ~F.col("_blank"), F.lit(False))
          for s in SIGNALS}
    return df.withColumns(on).drop("_money_hit", "_blank", *([] if lowered else [low_name]))


def flag_score() -> Column:
    """Capped sum of points of the ``sig_*`` columns."""
    points = reduce(add, (F.when(F.col(f"sig_{s}"), p).otherwise(0)
                          for s, p in K.SIGNAL_POINTS.items()))
    return F.least(points, F.lit(K.SCORE_CAP))


def flag_texts() -> Column:
    """Texts of the signals that fired, in rule order."""
    urls = F.concat(
        F.lit(K.SIGNAL_TEXT["url"]), F.when(F.col("n_urls") > 1, "s").otherwise(""),
        F.lit(" ("), F.col("n_urls").cast("string"), F.lit(")"),
    )
    return F.array_compact(F.array(*[
        F.when(F.col(f"sig_{s}"), urls if s == "url" else F.lit(K.SIGNAL_TEXT[s]))
        for s in SIGNALS
    ]))


def score_messages(
    df: DataFrame, text: str = "message", keep_flags: bool = False, lowered: str | None = None,
) -> DataFrame:
    """Add ``risk_score``, ``risk_level`` and ``signals``."""
    out = (
        with_flags(df, text, lowered)
        .withColumns({"risk_score": flag_score(), "signals": flag_texts()})
        .withColumn("risk_level", score_level(F.col("risk_score")))
    )
    return out if keep_flags else out.drop("n_urls", *[f"sig_{s}" for s in SIGNALS])
