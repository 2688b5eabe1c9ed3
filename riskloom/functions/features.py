"""Seventeen hand-made features and the six evidence variables of a message."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import entities
from riskloom.functions.rules import exclamations, has_email
from riskloom.functions.text import may_hold_money, may_hold_url
from riskloom.functions.words import contains_any


def _quoted(words: list[str]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


# A word in capitals: no lower-case letter, at least one upper-case, two characters.
# Ordinary words fail at their first lower-case letter, before anything is looked up.
_CAPITALS = (
    rf"(?<!{K.NS})(?=[^\p{{IsLowercase}}\p{{Lt}}{K.SPACE}]{{2,}}+(?!{K.NS}))"
    rf"[^\p{{IsUppercase}}{K.SPACE}]*+\p{{IsUppercase}}{K.NS}*+"
)
# A negation token with a signal word among the next few whole tokens.
_SIGNAL_TOKENS = [w for w in K.URGENCY_WORDS + K.CREDENTIAL_WORDS + K.PRIZE_WORDS if " " not in w]
_NEGATED = (
    rf"(?<!{K.NS})(?:{_quoted(K.NEGATION_WORDS)})"
    rf"(?:{K.S}++{K.NS}++){{0,{K.NEGATION_WINDOW - 1}}}?"
    rf"{K.S}++(?:{_quoted(_SIGNAL_TOKENS)})(?!{K.NS})"
)
_NEGATION_TOKEN = rf"(?<!{K.NS})(?:{_quoted(K.NEGATION_WORDS)})(?!{K.NS})"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{K.NS}+"))


def uppercase_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_CAPITALS))


def negation_score(lowered: Column, may_signal: Column | bool = True) -> Column:
    """-1 where a signal word is negated; ``may_signal`` spares texts without any signal word."""
    return F.when(F.lit(may_signal) & lowered.rlike(_NEGATED), -1.0).otherwise(0.0)


def has_negation(lowered: Column) -> Column:
    return lowered.rlike(_NEGATION_TOKEN)


def _number(flag: Column) -> Column:
    return flag.cast("double")


def with_manual_features(df: DataFrame, text: str = "message") -> DataFrame:
    """Add the columns of ``MANUAL_FEATURES``, all DOUBLE, in their fixed order."""
    df = df.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_low", F.lower("_raw"))
    t = F.col("_raw")
    df = df.withColumns({
        "_urgent": contains_any("_low", K.URGENCY_WORDS),
        "_asks": contains_any("_low", K.CREDENTIAL_WORDS),
        "_prize": contains_any("_low", K.PRIZE_WORDS),
        "_phones": F.regexp_count(t, F.lit(K.ENTITY_PHONE)),
        "_amounts": F.when(
            may_hold_money(t, K.ENTITY_MONEY_MARKS), F.regexp_count(t, F.lit(K.ENTITY_AMOUNT))
        ).otherwise(0),
        "_others": reduce(add, (
            F.when(may_hold_url(t), F.regexp_count(t, F.lit(K.ENTITY_URL))).otherwise(0),
            F.regexp_count(t, F.lit(K.ENTITY_BANK)),
            F.size(entities.accounts(t)),
        )),
    })
    features = {
        "msg_length": F.length(t).cast("double"),
        "word_count": word_count(t).cast("double"),
        "exclamation_count": exclamations(t).cast("double"),
        "question_count": (
            F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
        ).cast("double"),
        "has_url": _number(t.rlike(K.FEATURE_URL)),
        "has_phone": _number(t.rlike(K.FEATURE_PHONE)),
        "has_email": _number(t.contains(K.EMAIL_TOKEN) | has_email(t)),
        "has_money": _number(t.rlike(K.FEATURE_MONEY)),
        "uppercase_word_count": uppercase_words(t).cast("double"),
        "has_urgency": _number(F.col("_urgent")),
        "has_money_words": _number(contains_any("_low", K.MONEY_WORDS)),
        "has_credential_words": _number(F.col("_asks")),
        "has_prize_words": _number(F.col("_prize")),
        "negation_score": negation_score(
            F.col("_low"), F.col("_urgent") | F.col("_asks") | F.col("_prize")),
        "entity_count": (F.col("_phones") + F.col("_amounts") + F.col("_others")).cast("double"),
        "has_phone_ner": _number(F.col("_phones") > 0),
        "has_amount_ner": _number(F.col("_amounts") > 0),
    }
    return df.withColumns(features).drop(
        "_raw", "_low", "_urgent", "_asks", "_prize", "_phones", "_amounts", "_others")


def with_evidence(df: DataFrame, text: str = "message") -> DataFrame:
    """Add the six 0/1 evidence variables of ``EVIDENCE``."""
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("_low")
    flags = {
        "url_present": low.rlike(K.EVIDENCE_URL),
        "urgency": contains_any("_low", K.URGENCY_WORDS),
        "credential_request": contains_any("_low", K.CREDENTIAL_WORDS),
        "bank_mentioned": contains_any("_low", K.BANK_WORDS),
        "amount_present": low.rlike(K.EVIDENCE_AMOUNT),
        "negation_present": has_negation(low),
    }
    return df.withColumns({k: v.cast("int") for k, v in flags.items()}).drop("_low")
