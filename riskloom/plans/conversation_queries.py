"""Queries over conversations: windows, patterns, merged spans, paths."""

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.levels import conversation_level
from riskloom.functions.rules import score_messages
from riskloom.operators import conversations as C
from riskloom.operators import encoding as E
from riskloom.plans import tables as T
from riskloom.session import staged
from riskloom.sources import reports

# The generated prose seldom reaches the usual threshold of 0.40; the lower
# setting gives the merge step work to do.
LOW = {"candidate_threshold": 0.10}


def enriched(spark, folder):
    """Turns with rule fields and a stand-in class taken from the rule score."""
    scored = C.enrich(T.turns(spark, folder))
    risky = F.col("risk_score") >= K.SCORE_MEDIUM
    return scored.withColumns({
        "ml_label": F.when(risky, K.FRAUDULENT).otherwise(K.LEGITIMATE),
        "ml_confidence": F.greatest(F.col("risk_score"), 100 - F.col("risk_score")) / 100.0})


def features(spark, folder):
    return C.window_features(C.profile_turns(enriched(spark, folder)))


def _rounded(df, keys, digits=6):
    return df.select(*keys, *[
        F.round(c, digits).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes if c not in keys])


def k1(spark, folder):
    return enriched(spark, folder).select(
        "conv_id", "turn", "sender", "risk_score", "risk_level",
        F.array_join("signals", " | ").alias("signals"), "ml_label", "ml_confidence")


def k2(spark, folder):
    return C.windows(T.turns(spark, folder), ["sender"]).select(
        "conv_id", F.col("win")[0]["turn"].alias("start_idx"),
        F.element_at("win", -1)["turn"].alias("end_idx"),
        F.array_join("win.sender", ",").alias("senders"))


def k3_k8(spark, folder):
    return _rounded(features(spark, folder), ["conv_id", "start_idx", "end_idx"])


def k9_k10(spark, folder):
    return _rounded(C.score_patterns(features(spark, folder)), ["conv_id", "start_idx", "end_idx"])


def _candidates(config):
    def run(spark, folder):
        found = C.candidates(C.score_patterns(features(spark, folder)), config)
        return _rounded(found, ["conv_id", "start_idx", "end_idx"])
    return run


def k12(spark, folder):
    spans = C.candidates(C.score_patterns(features(spark, folder)), LOW)
    # Six decimals decide ties the same way in every engine.
    return C.merge_spans(spans.withColumn("score", F.round("score", 6)))


def verdicts(matches):
    """Stand-in for an outside reviewer: confirms every second span."""
    return matches.select(
        "conv_id", "pattern_type", "start_idx", "end_idx",
        (F.col("start_idx") % 2 == 0).alias("is_suspicious"),
        (0.5 + F.col("end_idx") * 0.05).alias("verdict_confidence"))


def _confirmed(spark, folder):
    spans = staged(k12(spark, folder), "spans")
    return C.combine_verdicts(spans, verdicts(spans))


def k13_k14(spark, folder):
    return _confirmed(spark, folder).withColumn(
        "risk_level", conversation_level(F.col("confidence")))


def k15(spark, folder):
    return C.summarize(T.turns(spark, folder), _confirmed(spark, folder))


def conversation_report(spark, folder):
    """Flagship conversation query at the usual settings, with the stand-in class, without a model."""
    turns = enriched(spark, folder)
    return C.summarize(turns, C.find_patterns(turns))


def k16(spark, folder):
    return _rounded(E.encode_turns(enriched(spark, folder)), ["conv_id", "turn"])


def k17(spark, folder):
    packed = E.encode_conversations(enriched(spark, folder))
    return packed.select(
        "conv_id", F.size("encoding").alias("length"),
        F.size(F.filter("mask", lambda m: m)).alias("n_padding"),
        F.round(F.aggregate(F.flatten("encoding"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def k19(spark, folder):
    scored = score_messages(T.messages(spark, folder)).select("msg_id", "risk_score").join(
        T.labels(spark, folder), "msg_id")
    return E.training_sequences(scored, 5000)


def k20(spark, folder):
    return E.transitions(T.events(spark, folder))


def _path(df, risk):
    return E.worst_path(df, risk).withColumn("path", F.array_join("path", ","))


def k21_k24(spark, folder):
    rows = C.enrich(T.turns(spark, folder)).withColumn("risk", F.col("risk_score") / 100.0)
    return _path(rows, "risk")


def k23(spark, folder):
    rows = E.with_heuristic_risk(T.turns(spark, folder)).withColumn("risk", F.round("risk", 6))
    return _path(rows, "risk")


def a13(spark, folder):
    rows = staged(enriched(spark, folder), "turns")
    spans = staged(C.find_patterns(rows, config=LOW), "spans")
    pages = reports.report_pages(rows, spans)
    return pages.select(
        "conv_id", "page", "total_messages", "overall_risk", "overall_score", "patterns_found",
        F.size("pattern_matches").alias("n_matches"),
        F.size("per_message_risk").alias("n_messages"),
        F.array_join(F.transform("per_message_risk", lambda m: m["text"]), "|").alias("texts"))


def o7(spark, folder):
    return C.enrich(T.turns(spark, folder)).select(
        "conv_id", "turn", "sender", "risk_score", "risk_level")


QUERIES = {
    "a13_conversation_report": a13,
    "k1_enriched_turns": k1,
    "k2_windows": k2,
    "k3_k8_window_features": k3_k8,
    "k9_k10_pattern_scores": k9_k10,
    "k11_candidates": _candidates(None),
    "k11_candidates_low_threshold": _candidates(LOW),
    "k12_merged_spans": k12,
    "k13_k14_confirmed_spans": k13_k14,
    "k15_conversation_summary": k15,
    "k15_conversation_report": conversation_report,
    "k16_turn_encoding": k16,
    "k17_padded_encoding": k17,
    "k19_training_sequences": k19,
    "k20_transition_table": k20,
    "k21_k24_worst_path": k21_k24,
    "k23_heuristic_path": k23,
    "o7_risk_series": o7,
}
