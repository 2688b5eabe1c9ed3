"""Sliding windows over conversations, behavioural patterns, merged spans.

A conversation may hold a large share of all rows, so it is never gathered as a
whole.  Turns are cut into blocks of ``BLOCK`` turns plus the few that windows
reach into; every later step works on such blocks, on single windows, or on runs
of overlapping suspicious windows.
"""

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import words as V
from riskloom.functions.levels import conversation_level
from riskloom.functions.rules import score_messages
from riskloom.session import staged

BLOCK = 64
_HALVES = {"urg": K.URGENCY_WORDS, "cred": K.CREDENTIAL_WORDS, "prize": K.PRIZE_WORDS}
_COUNTED = {"imp": K.IMPERSONATION_WORDS, "press": K.PRESSURE_WORDS, "trans": K.TRANSFER_WORDS}


def enrich(turns: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Add rule fields to every turn, and class and confidence where known.

    ``classes``: ``conv_id, turn, ml_label, ml_confidence``.
    """
    scored = score_messages(turns.withColumn("_text", F.coalesce("text", F.lit(""))), "_text")
    scored = scored.drop("_text")
    if classes is None:
        return scored.withColumns({
            "ml_label": F.lit(None).cast("string"), "ml_confidence": F.lit(None).cast("double")})
    return scored.join(classes, ["conv_id", "turn"], "left")


def profile_turns(enriched: DataFrame) -> DataFrame:
    """Numbers of each turn that window features need; no text is passed on."""
    low, bits = "_low", {}
    for name, vocabulary in _HALVES.items():
        bits[f"{name}_bits"] = V.hit_bits(low, vocabulary)
        bits[f"{name}_head"] = V.head_bits(low, vocabulary)
        bits[f"{name}_tail"] = V.tail_bits(low, vocabulary)
    for name, vocabulary in _COUNTED.items():
        bits[f"n_{name}"] = F.bit_count(V.hit_bits(low, vocabulary))
    return enriched.withColumn("_low", F.lower(F.coalesce("text", F.lit("")))).select(
        "conv_id", "turn", "risk_score", F.size("signals").alias("n_signals"),
        F.coalesce((F.col("ml_label") == K.FRAUDULENT).cast("int"), F.lit(0)).alias("is_fraud"),
        F.coalesce((F.col("ml_label") == K.LEGITIMATE).cast("int"), F.lit(0)).alias("is_legit"),
        *[c.alias(n) for n, c in bits.items()])


def with_positions(rows: DataFrame, out: str = "_pos", stretch: int = 4096) -> DataFrame:
    """Add the position of every turn in its conversation: from 0, without gaps.

    Turn numbers may start anywhere and have gaps. Counts of stretches of turn numbers
    give each stretch its first position, so only a stretch is ever sorted together.
    """
    part = F.floor(F.col("turn") / stretch)
    counts = rows.groupBy("conv_id", part.alias("_part")).agg(F.count("*").alias("_in"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("conv_id", "_part", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("conv_id", "_part").orderBy("turn")
    return rows.withColumn("_part", part).join(firsts, ["conv_id", "_part"]).withColumn(
        out, (F.col("_first") + F.row_number().over(inside) - 1).cast("int")).drop("_part", "_first")


def turn_blocks(rows: DataFrame, reach: int, payload: list[str], block: int = BLOCK) -> DataFrame:
    """``(conv_id, block, turns)``: turns of a block and ``reach`` turns after it.

    Blocks count positions, whatever the turn numbers are; ``turns`` is sorted and
    bounded in length.
    """
    own = F.floor(F.col("_pos") / block).cast("int")
    also = F.when((F.col("_pos") % block < reach) & (own > 0), own - 1)
    placed = with_positions(rows).select(
        "conv_id", F.struct("turn", *payload).alias("_t"),
        F.explode(F.array_compact(F.array(own, also))).alias("block"))
    return placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list("_t")).alias("turns"))


def windows(rows: DataFrame, payload: list[str], sizes: list[int] | None = None) -> DataFrame:
    """``(conv_id, win)``: every contiguous window of the given sizes."""
    sizes = sizes or K.WINDOW_SIZES
    blocks = turn_blocks(rows, max(sizes) - 1, payload).withColumn(
        "_own", F.least(F.size("turns"), F.lit(BLOCK)))

    def starts(w: Column) -> Column:
        last = F.least(F.col("_own"), F.size("turns") - w + 1)
        return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
            F.array().cast("array<int>"))

    every = F.flatten(F.transform(
        F.array(*[F.lit(s) for s in sizes]),
        lambda w: F.transform(starts(w), lambda i: F.slice("turns", i, w))))
    return blocks.select("conv_id", F.explode(every).alias("win"))


def window_features(profiled: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """The 25 features of every window, with ``start_idx`` and ``end_idx``.

    Windows are short, so sums over a window are written out term by term and
    stay inside generated code.
    """
    sizes = sizes or K.WINDOW_SIZES
    widest = max(sizes)
    payload = [c for c in profiled.columns if c not in ("conv_id", "turn")]
    wins = windows(profiled, payload, sizes)
    turns = range(widest)
    cells = wins.selectExpr(
        "conv_id", "win[0].turn AS start_idx", "element_at(win, -1).turn AS end_idx",
        "size(win) AS n", "greatest(size(win) div 2, 1) AS half",
        *[f"get(win.{c}, {j}) AS {c}_{j}" for c in payload for j in turns])
    early, late = (lambda j: f"{j} < half"), (lambda j: f"{j} >= half")

    def total(value: str, where=None) -> str:
        """Sum over the window of ``value``, where ``#`` stands for the position."""
        terms = [value.replace("#", str(j)) for j in turns]
        if where is not None:
            terms = [f"if({where(j)}, {t}, 0)" for j, t in zip(turns, terms)]
        return "(" + " + ".join(f"coalesce({t}, 0)" for t in terms) + ")"

    def union(name: str, where) -> str:
        """Number of words in the joined text of the chosen turns: words inside a
        turn, and phrases from the end of one turn to the start of the next."""
        parts = [f"if({where(j)}, coalesce({name}_bits_{j}, 0L), 0L)" for j in turns]
        parts += [
            f"if({where(j)} AND {where(j + 1)}, "
            f"coalesce({name}_tail_{j} & {name}_head_{j + 1}, 0L), 0L)" for j in turns[:-1]]
        return "bit_count(" + " | ".join(parts) + ")"

    def slope(name: str) -> str:
        """Least squares over positions 0..n-1, whose squares sum to n(n^2-1)/12."""
        return f"{total(f'{name}_# * (# - (n - 1) / 2.0D)')} / (n * (n * n - 1) / 12.0D)"

    def last(name: str) -> str:
        return "coalesce(" + ", ".join(f"{name}_{j}" for j in reversed(turns)) + ")"

    risk, fraud, legit = "risk_score_#", "is_fraud_#", "is_legit_#"
    columns = {
        "n_messages": "n",
        "risk_slope": slope("risk_score"),
        "risk_delta": f"{last('risk_score')} - risk_score_0",
        "risk_max": "greatest(" + ", ".join(f"risk_score_{j}" for j in turns) + ")",
        "risk_mean": f"{total(risk)} / n",
        # Whole numbers up to the division, so nothing is rounded before it.
        "risk_variance":
            f"(n * {total('risk_score_# * risk_score_#')} - {total(risk)} * {total(risk)}) / (n * n)",
        "last_risk": last("risk_score"),
        "early_risk_mean": f"{total(risk, early)} / half",
        "late_risk_mean": f"{total(risk, late)} / (n - half)",
        "ml_fraud_ratio": f"{total(fraud)} / n",
        "ml_fraud_late_ratio": f"{total(fraud, late)} / (n - half)",
        "ml_legit_early_ratio": f"{total(legit, early)} / half",
        "signal_total": total("n_signals_#"),
        "signal_slope": slope("n_signals"),
        "signal_last": last("n_signals"),
        "urgency_count": total("bit_count(urg_bits_#)"),
        "credential_count": total("bit_count(cred_bits_#)"),
        "prize_count": total("bit_count(prize_bits_#)"),
        "impersonation_count": total("n_imp_#"),
        "pressure_count": total("n_press_#"),
        "transfer_count": total("n_trans_#"),
        "urgency_late": union("urg", late),
        "credential_late": union("cred", late),
        "prize_early": union("prize", early),
    }
    sums = cells.selectExpr(
        "conv_id", "start_idx", "end_idx",
        *[f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in columns.items()])
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1.0))
    return sums.withColumns({
        "risk_acceleration": F.col("late_risk_mean") - F.col("early_risk_mean"),
        "late_risk_spike": F.when(
            (F.col("n_messages") > 2)
            & (F.col("last_risk") > F.col("risk_mean") + 1.5 * F.sqrt("risk_variance") + 1e-9), 1.0,
        ).otherwise(0.0),
        "urgency_late_ratio": share("urgency_late", "urgency_count"),
        "credential_late_ratio": share("credential_late", "credential_count"),
        "prize_early_ratio": share("prize_early", "prize_count"),
    }).select("conv_id", "start_idx", "end_idx", *K.WINDOW_FEATURES)


def _upto(value: Column, limit: float) -> Column:
    """value / limit, held between 0 and 1."""
    return F.least(F.greatest(value / limit, F.lit(0.0)), F.lit(1.0))


def pattern_scores() -> dict[str, Column]:
    """Score of every pattern over the window feature columns."""
    c = F.col
    urgent, transfer = _upto(c("urgency_count"), 3.0), _upto(c("transfer_count"), 2.0)
    posing, fraud = _upto(c("impersonation_count"), 2.0), c("ml_fraud_ratio")
    weigh = lambda count, limit, ratio: _upto(c(count), limit) * (0.5 + 0.5 * c(ratio))
    rise = _upto(c("risk_delta"), 60.0)
    request = F.least(F.greatest(
        c("credential_late_ratio") * _upto(c("credential_count"), 1.0), transfer,
        c("ml_fraud_late_ratio") * 0.6), F.lit(1.0))
    long_enough = c("n_messages") >= 4
    scores = {
        "urgency_escalation":
            0.40 * _upto(c("risk_slope"), 8.0) + 0.40 * _upto(c("risk_acceleration"), 30.0)
            + 0.20 * weigh("urgency_count", 3.0, "urgency_late_ratio"),
        "credential_harvesting":
            0.40 * weigh("credential_count", 2.0, "credential_late_ratio") + 0.25 * posing
            + 0.20 * fraud + 0.15 * urgent,
        "social_engineering": F.when(
            long_enough,
            0.50 * c("ml_legit_early_ratio") * c("ml_fraud_late_ratio")
            + 0.30 * _upto(c("risk_acceleration"), 35.0) + 0.20 * c("late_risk_spike"),
        ).otherwise(0.0),
        "impersonation":
            0.45 * posing + 0.30 * _upto(c("urgency_count") + c("credential_count"), 3.0)
            + 0.25 * fraud,
        "prize_scam_sequence": F.when(
            c("prize_count") >= 1,
            0.50 * _upto(c("prize_count"), 2.0) * c("prize_early_ratio") + 0.50 * request,
        ).otherwise(0.0),
        "financial_coercion":
            0.35 * _upto(c("pressure_count"), 2.0) + 0.35 * transfer + 0.15 * urgent + 0.15 * fraud,
        "trust_building_attack": F.when(
            long_enough,
            0.60 * c("ml_legit_early_ratio") * (0.5 * c("late_risk_spike") + 0.5 * rise)
            + 0.40 * rise,
        ).otherwise(0.0),
    }
    return {name: F.least(score, F.lit(K.PATTERN_CAP)) for name, score in scores.items()}


def score_patterns(features: DataFrame) -> DataFrame:
    """One row per window and applicable pattern: ``pattern_type, pattern_score``."""
    registry = [F.struct(F.lit(name).alias("pattern_type"), F.lit(K.PATTERNS[name][0]).alias("least"),
                         score.alias("pattern_score"))
                for name, score in pattern_scores().items()]
    keep = [c for c in ("model_score",) if c in features.columns]
    return features.select(
        "conv_id", "start_idx", "end_idx", "n_messages", *keep, F.explode(F.array(*registry)).alias("p"),
    ).filter(F.col("n_messages") >= F.col("p.least")).select(
        "conv_id", "start_idx", "end_idx", *keep, "p.pattern_type", "p.pattern_score")


def candidates(scored: DataFrame, config: dict | None = None) -> DataFrame:
    """Blend with the window model where it has a score; keep strong windows."""
    cfg = {**K.CONVERSATION_DEFAULTS, **(config or {})}
    score = F.col("pattern_score")
    if "model_score" in scored.columns:
        model = F.col("model_score")
        score = F.when(
            model.isNotNull(), cfg["pattern_weight"] * score + cfg["model_weight"] * model,
        ).otherwise(score)
    return scored.select("conv_id", "pattern_type", "start_idx", "end_idx", score.alias("score")).filter(
        F.col("score") >= cfg["candidate_threshold"])


def _islands(spans: DataFrame, keys: list[str], block: int = 1024) -> DataFrame:
    """Add ``island``: spans of one island share messages, spans of two do not.

    A position is a border between two neighbouring messages covered by some
    span.  Numbering the positions by blocks (rank inside the block plus the
    total of earlier blocks) makes runs of consecutive positions share
    ``position - rank``.
    """
    borders = spans.select(
        *keys, F.explode(F.sequence(F.col("start_idx") + 1, F.col("end_idx"))).alias("_p"),
    ).distinct().withColumn("_b", F.floor(F.col("_p") / block))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = borders.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).select(
        *keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_p"))
    runs = borders.withColumn("_r", rank).join(offsets, [*keys, "_b"]).select(
        *keys, (F.col("_p") - 1).alias("start_idx"),
        (F.col("_p") - F.col("_r") - F.col("_before")).alias("island"))
    return spans.join(runs, [*keys, "start_idx"])


def merge_spans(spans: DataFrame, overlap_ratio: float | None = None) -> DataFrame:
    """Merge overlapping candidate spans of one pattern, keeping the higher score.

    Spans are visited by (start, score descending, end).  A span that overlaps a
    kept one by ``overlap_ratio`` of the shorter is absorbed by the first such
    span, and replaces it when its score is higher.  Only spans that share
    messages can affect each other, so every island is scanned on its own, in order,
    by scores of six decimals, so that equal ones tie whatever order they were summed in,
    holding no more than the spans that reach the current turn.
    """
    ratio = K.CONVERSATION_DEFAULTS["overlap_ratio"] if overlap_ratio is None else overlap_ratio
    # Read twice below; few rows compared with the windows they come from.
    spans = staged(spans, "candidates")
    keys = ["conv_id", "pattern_type"]
    ordered = _islands(spans, keys).select(
        *keys, "island", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"),
        F.round(F.col("score").cast("double"), 6).alias("score")).repartition(*keys, "island") \
        .sortWithinPartitions(*keys, "island", "start_idx", F.desc("score"), "end_idx")
    kind = spans.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_scan(ratio), f"conv_id {kind}, pattern_type string, start_idx int, end_idx int, rule_score double")


def _scan(ratio: float) -> Callable:
    """Ordered scan over the spans of a partition; only spans that can still overlap are held."""
    names = ["conv_id", "pattern_type", "start_idx", "end_idx", "rule_score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, done, types = None, [], [], None

        def written() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "pattern_type", "start_idx", "end_idx", "score")]
            types = [c.type for c in columns]
            islands = batch.column("island").to_pylist()
            for conv, pattern, start, end, score, island in zip(*(c.to_pylist() for c in columns), islands, strict=True):
                if (conv, pattern, island) != group:
                    done += [(*group[:2], *k) for k in held]
                    group, held = (conv, pattern, island), []
                elif ratio > 0:
                    done += [(conv, pattern, *k) for k in held if k[1] < start]
                    held = [k for k in held if k[1] >= start]
                for k in held:
                    shared = max(min(k[1], end) - max(k[0], start) + 1, 0)
                    if shared / (min(k[1] - k[0], end - start) + 1) >= ratio:
                        if score > k[2]:
                            k[:] = start, end, score
                        break
                else:
                    held.append([start, end, score])
            yield written()
            done = []
        if held:
            done = [(*group[:2], *k) for k in held]
            yield written()
    return work


def combine_verdicts(matches: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Add ``confidence``: the score, or its blend with a confirming verdict.

    ``verdicts``: ``conv_id, pattern_type, start_idx, end_idx, is_suspicious,
    verdict_confidence``.
    """
    if verdicts is None:
        return matches.withColumn("confidence", F.col("rule_score"))
    conf = F.coalesce("verdict_confidence", F.lit(0.5))
    weight = F.when(conf >= 0.70, 0.60).otherwise(0.40)
    joined = matches.join(verdicts, ["conv_id", "pattern_type", "start_idx", "end_idx"], "left")
    return joined.withColumn("confidence", F.when(
        F.coalesce("is_suspicious", F.lit(False)),
        F.round(weight * conf + (1 - weight) * F.col("rule_score"), 3),
    ).otherwise(F.col("rule_score"))).drop("is_suspicious", "verdict_confidence")


def find_patterns(
    enriched: DataFrame, verdicts: DataFrame | None = None, config: dict | None = None,
    model_scores: DataFrame | None = None,
) -> DataFrame:
    """Suspicious spans ``(conv_id, pattern_type, start_idx, end_idx, rule_score,
    confidence, risk_level)``."""
    cfg = {**K.CONVERSATION_DEFAULTS, **(config or {})}
    features = window_features(profile_turns(enriched))
    if model_scores is not None:
        features = features.join(model_scores, ["conv_id", "start_idx", "end_idx"], "left")
    spans = merge_spans(candidates(score_patterns(features), cfg), cfg["overlap_ratio"])
    return combine_verdicts(spans, verdicts).withColumn(
        "risk_level", conversation_level(F.col("confidence"), cfg))


def summarize(turns: DataFrame, matches: DataFrame, config: dict | None = None) -> DataFrame:
    """One row per conversation; conversations without a pattern stay, low and 0."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("total_messages"))
    best = matches.groupBy("conv_id").agg(
        F.count("*").alias("patterns_found"), F.max("confidence").alias("overall_score"))
    return sizes.join(best, "conv_id", "left").select(
        "conv_id", "total_messages",
        F.coalesce("patterns_found", F.lit(0)).alias("patterns_found"),
        F.coalesce("overall_score", F.lit(0.0)).alias("overall_score"),
    ).withColumn("overall_risk", conversation_level(F.col("overall_score"), config))


# Task functions travel by value: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
