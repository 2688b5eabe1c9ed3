"""Nested conversation reports and metric files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.levels import lookup
from riskloom.operators.conversations import summarize

PAGE = 1000


def report_pages(enriched: DataFrame, matches: DataFrame, page: int = PAGE) -> DataFrame:
    """Nested report rows, one per conversation and ``page`` turns.

    A conversation of up to ``page`` turns is a single row.  Longer ones continue
    on further rows, so that no row or group grows without bound.
    """
    ids = ["conv_id", "pattern_type", "start_idx", "end_idx"]
    said = matches.select(
        *ids, F.explode(F.sequence("start_idx", "end_idx")).alias("turn")
    ).join(enriched.select("conv_id", "turn", "text", "sender"), ["conv_id", "turn"]).groupBy(
        *ids).agg(F.sort_array(F.collect_list(F.struct(
            F.col("turn").alias("idx"), "text", "sender"))).alias("messages"))
    described = lookup(F.col("pattern_type"), {k: v[1] for k, v in K.PATTERNS.items()})
    match = F.struct(
        (-F.round("confidence", 3)).alias("_order"), "pattern_type",
        described.alias("description"),
        F.concat(F.lit("["), "start_idx", F.lit("–"), "end_idx", F.lit("]")).alias("span"),
        "messages", F.round("rule_score", 3).alias("rule_score"),
        F.round("confidence", 3).alias("confidence"), "risk_level")
    found = matches.join(said, ids).groupBy(
        "conv_id", F.floor(F.col("start_idx") / page).alias("page")
    ).agg(F.sort_array(F.collect_list(match)).alias("_m")).select(
        "conv_id", "page", F.transform("_m", lambda m: m.dropFields("_order")).alias("pattern_matches"))
    turns = enriched.groupBy("conv_id", F.floor(F.col("turn") / page).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("turn").alias("idx"),
            F.substring("text", 1, K.REPORT_TEXT_CHARS).alias("text"), "sender",
            "risk_score", "risk_level", "signals"))).alias("per_message_risk"))
    head = summarize(enriched, matches).withColumn("overall_score", F.round("overall_score", 3))
    return turns.join(found, ["conv_id", "page"], "left").join(head, "conv_id").select(
        "conv_id", "page", "total_messages", "overall_risk", "overall_score", "patterns_found",
        F.coalesce("pattern_matches", F.array().cast(
            found.schema["pattern_matches"].dataType)).alias("pattern_matches"),
        "per_message_risk")


def write_json(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).json(path)
    return path


def write_metrics(metrics: DataFrame, report: DataFrame, folder: str) -> None:
    """Metric numbers as JSON rows and the per-class report as text lines."""
    metrics.write.json(f"{folder}/metrics")
    line = F.format_string(
        "%-16s %10.4f %10.4f %10.4f %10d", "class", "precision", "recall", "f1_score", "support")
    report.select(line.alias("value")).coalesce(1).write.text(f"{folder}/report")
