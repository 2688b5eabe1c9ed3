"""Queries over single messages: cleaning, rules, entities, features."""

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import entities, features, rules, text
from riskloom.functions.levels import recommendation
from riskloom.plans import tables as T


def _text_query(fn):
    def run(spark, folder):
        return T.messages(spark, folder).select("msg_id", fn(F.col("message")).alias("result"))
    return run


def tokenize(spark, folder):
    words = text.words(F.col("message"))
    return (
        T.messages(spark, folder).select("msg_id", words.alias("w"))
        .select("msg_id", F.size("w").alias("n_tokens"),
                F.array_join("w", "|").alias("tokens"))
    )


def clean(spark, folder):
    return text.clean_steps(T.messages(spark, folder), "message", "clean").select(
        "msg_id", "clean")


def clean_table(spark, folder):
    return text.clean_messages(T.labelled(spark, folder)).select("msg_id", "label", "message")


def signal_flags(spark, folder):
    df = rules.with_flags(T.messages(spark, folder))
    return df.select("msg_id", "n_urls", *[
        F.col(f"sig_{s}").cast("int").alias(f"sig_{s}") for s in rules.SIGNALS])


def rule_score(spark, folder):
    return rules.score_messages(T.messages(spark, folder)).select(
        "msg_id", "risk_score", "risk_level",
        F.array_join("signals", " | ").alias("signals"))


def risk_by_language(spark, folder):
    """Flagship report: how risky the messages of each language are."""
    scored = rules.score_messages(T.messages(spark, folder))
    return scored.groupBy("lang", "risk_level").agg(
        F.count("*").alias("n_messages"),
        F.round(F.avg("risk_score"), 4).alias("mean_score"),
        F.max("risk_score").alias("max_score"),
    )


def risk_by_source(spark, folder):
    scored = rules.score_messages(T.messages(spark, folder))
    return scored.groupBy("source").agg(
        F.count("*").alias("n_messages"),
        F.sum((F.col("risk_level") == "high").cast("int")).alias("n_high"),
        F.round(F.avg("risk_score"), 4).alias("mean_score"),
    )


def _entity_lists(*names):
    def run(spark, folder):
        df = T.messages(spark, folder)
        cols = [F.array_join(getattr(entities, n)(F.col("message")), " | ").alias(n)
                for n in names]
        return df.select("msg_id", *cols)
    return run


def entity_counts(spark, folder):
    return entities.with_entities(T.messages(spark, folder)).select(
        "msg_id", "entity_count", "has_phone", "has_url", "has_amount", "has_bank",
        "has_account")


def manual_features(spark, folder):
    return features.with_manual_features(T.messages(spark, folder)).select(
        "msg_id", *K.MANUAL_FEATURES)


def manual_features_clean(spark, folder):
    cleaned = text.clean_steps(T.messages(spark, folder), "message", "message")
    return features.with_manual_features(cleaned).select("msg_id", *K.MANUAL_FEATURES)


def evidence(spark, folder):
    cleaned = text.clean_steps(T.messages(spark, folder), "message", "message")
    return features.with_evidence(cleaned).select("msg_id", *K.EVIDENCE)


def entry_scores(spark, folder):
    return rules.score_messages(T.messages(spark, folder)).select(
        "msg_id", "lang", "source", "risk_score", "risk_level", "signals",
        recommendation(F.col("risk_level")).alias("recommendation"))


QUERIES = {
    "b1_normalize_urls": _text_query(text.normalize_urls),
    "b2_normalize_emails": _text_query(text.normalize_emails),
    "b3_normalize_phones": _text_query(text.normalize_phones),
    "b4_normalize_money": _text_query(text.normalize_money),
    "b5_drop_irrelevant_chars": _text_query(text.drop_irrelevant),
    "b6_collapse_spaces": _text_query(text.collapse_spaces),
    "b7_lower_case": _text_query(F.lower),
    "b8_tokenize": tokenize,
    "b9_clean_text": clean,
    "b10_clean_table": clean_table,
    "c1_c12_signal_flags": signal_flags,
    "c13_c16_rule_score": rule_score,
    "c14_risk_by_language": risk_by_language,
    "c14_risk_by_source": risk_by_source,
    "d1_phones": _entity_lists("phones"),
    "d2_d5_entity_lists": _entity_lists("urls", "amounts", "accounts", "banks"),
    "d6_entity_counts": entity_counts,
    "e1_e8_manual_features": manual_features,
    "e8_manual_features_clean": manual_features_clean,
    "i1_evidence": evidence,
}
