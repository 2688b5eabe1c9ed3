"""Message risk encoding, worst path of a conversation, training sequences."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import words as V
from riskloom.operators.conversations import BLOCK
from riskloom.operators.ranking import HASH_MODULUS, top_per_group

ENCODING = ["risk", "level", "credential", "urgency", "pressure", "transfer", "prize",
            "financial", "text_len", "risk_delta"]


def encode_turns(enriched: DataFrame) -> DataFrame:
    """Ten numbers per turn; the last is the rise of risk since the turn before.

    The window runs over blocks of turns, with the last turn of a block repeated
    in front of the next one, so that a long conversation is not one group.
    """
    said = lambda *names: reduce(lambda a, b: a | b, (
        F.array_contains("signals", K.SIGNAL_TEXT[n]) for n in names)).cast("double")
    base = enriched.select(
        "conv_id", "turn", (F.col("risk_score") / 100.0).alias("risk"),
        F.when(F.col("risk_level") == "low", 0.0).when(
            F.col("risk_level") == "medium", 0.5).otherwise(1.0).alias("level"),
        said("credential").alias("credential"), said("urgency").alias("urgency"),
        said("pressure", "block").alias("pressure"), said("transfer").alias("transfer"),
        said("prize").alias("prize"), said("money", "money_words").alias("financial"),
        F.least(F.length(F.coalesce("text", F.lit(""))) / float(K.ENCODED_TEXT_CHARS),
                F.lit(1.0)).alias("text_len"))
    own = F.floor(F.col("turn") / BLOCK)
    after = F.when(F.col("turn") % BLOCK == BLOCK - 1, own + 1)
    placed = base.withColumn("_block", F.explode(F.array_compact(F.array(own, after))))
    before = F.lag("risk", 1, 0.0).over(Window.partitionBy("conv_id", "_block").orderBy("turn"))
    return placed.withColumn(
        "risk_delta", F.greatest(F.col("risk") - before, F.lit(0.0)),
    ).filter(F.floor(F.col("turn") / BLOCK) == F.col("_block")).drop("_block")


def encode_conversations(enriched: DataFrame, length: int = K.ENCODED_MESSAGES) -> DataFrame:
    """First ``length`` turns as a padded matrix and a mask (true = padding)."""
    rows = encode_turns(enriched.filter(F.col("turn") < length))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.array(*ENCODING).alias("v")))).alias("_rows"))
    missing = F.lit(length) - F.size("_rows")
    zeros = F.array(*[F.lit(0.0)] * len(ENCODING))
    return packed.select(
        "conv_id", F.concat(F.col("_rows.v"), F.array_repeat(zeros, missing)).alias("encoding"),
        F.concat(F.array_repeat(F.lit(False), F.size("_rows")),
                 F.array_repeat(F.lit(True), missing)).alias("mask"))


def with_heuristic_risk(df: DataFrame, text: str = "text", out: str = "risk") -> DataFrame:
    """Add the stand-alone risk of a text, 0 to 1."""
    df = df.withColumn("_low", F.lower(text))
    low = F.col("_low")
    hits = lambda vocabulary: F.bit_count(V.hit_bits("_low", vocabulary))
    return df.withColumn(out, F.least(reduce(add, (
        0.15 * hits(K.URGENCY_WORDS), 0.20 * hits(K.CREDENTIAL_WORDS), 0.10 * hits(K.MONEY_WORDS),
        F.when(low.rlike(K.PATH_URL), 0.25).otherwise(0.0),
        F.when(low.rlike(K.PATH_NUMBER), 0.10).otherwise(0.0))), F.lit(1.0))).drop("_low")


def worst_path(turns: DataFrame, risk: str, length: int = K.PATH_LENGTH) -> DataFrame:
    """The ``length`` riskiest turns of every conversation, in turn order.

    Columns: ``path`` (turns), ``path_score``, ``escalation_start`` and the
    readable ``manipulation_arc``.
    """
    snippet = F.concat(
        F.regexp_replace(F.substring("text", 1, K.SNIPPET_CHARS), "\n", " "),
        F.when(F.length("text") > K.SNIPPET_CHARS, "…").otherwise(""))
    r = F.col(risk)
    level = F.when(r < 0.3, "baja").when(r < 0.6, "media").otherwise("alta")
    step = F.concat(
        F.lit("msg["), F.col("turn").cast("string"), F.lit("] (riesgo "), level, F.lit(": "),
        F.round(r * 100).cast("int").cast("string"), F.lit("%) «"), snippet, F.lit("»"))
    means = turns.groupBy("conv_id").agg(F.avg(risk).alias("_mean"))
    top = top_per_group(
        turns.select("conv_id", "turn", "text", risk), ["conv_id"],
        [F.desc(risk), F.col("turn")], length)
    paths = top.withColumn("_step", step).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", r.alias("risk"), "_step"))).alias("_path"),
        F.avg(risk).alias("_score"))
    limit = F.greatest("_mean", F.lit(0.3))
    reached = F.filter("_path", lambda p: p["risk"] >= F.col("_limit"))
    label = F.when(F.col("_score") >= K.PATH_LEVELS[0][0], K.PATH_LEVELS[0][1]).when(
        F.col("_score") >= K.PATH_LEVELS[1][0], K.PATH_LEVELS[1][1]).otherwise(K.PATH_LEVELS[2][1])
    return paths.join(means, "conv_id").withColumn("_limit", limit).select(
        "conv_id", F.col("_path.turn").alias("path"), F.round("_score", 4).alias("path_score"),
        F.coalesce(F.get(reached, 0)["turn"], F.col("_path")[0]["turn"]).alias("escalation_start"),
        F.concat(label, F.lit(": "), F.array_join("_path._step", " → ")).alias("manipulation_arc"))


def transitions(events: DataFrame, state: str = "event_type", group: str = "user_id") -> DataFrame:
    """Observed transition table: count, probability, mean delay in seconds.

    Pairs are taken inside (group, day) blocks; the first event of the next
    block closes each block, so that one busy group is spread over its days.
    """
    rows = events.select(group, state, "ts", "event_id", F.to_date("ts").alias("_day"))
    inside = Window.partitionBy(group, "_day").orderBy("ts", "event_id")
    steps = rows.withColumns({
        "to_state": F.lead(state).over(inside), "_next": F.lead("ts").over(inside)})
    # One row per (group, day): first and last event, joined to the day after.
    edge = F.struct("ts", "event_id", state)
    days = rows.groupBy(group, "_day").agg(F.min(edge).alias("_first"), F.max(edge).alias("_last"))
    following = days.withColumn(
        "_then", F.lead("_first").over(Window.partitionBy(group).orderBy("_day")))
    seconds = lambda a, b: F.unix_micros(b.cast("timestamp")) / 1e6 - F.unix_micros(
        a.cast("timestamp")) / 1e6
    within = steps.filter(F.col("to_state").isNotNull()).select(
        F.col(state).alias("from_state"), "to_state", seconds(F.col("ts"), F.col("_next")).alias("_d"))
    across = following.filter(F.col("_then").isNotNull()).select(
        F.col(f"_last.{state}").alias("from_state"), F.col(f"_then.{state}").alias("to_state"),
        seconds(F.col("_last.ts"), F.col("_then.ts")).alias("_d"))
    counted = within.unionByName(across).groupBy("from_state", "to_state").agg(
        F.count("*").alias("n"), F.avg("_d").alias("_delay"))
    whole = F.sum("n").over(Window.partitionBy("from_state"))
    return counted.select(
        "from_state", "to_state", "n", F.round(F.col("n") / whole, 6).alias("probability"),
        F.round("_delay", 3).alias("mean_delay_seconds"))


def _numbered(pool: DataFrame, name: str) -> DataFrame:
    """Messages of a pool with numbers 0..n-1 by ``msg_id``, ranked in blocks.

    Totals go up two levels, blocks and stretches of blocks; the one window without
    groups sees a row for each stretch, that is for each 16 million ids.
    """
    width = 4096
    blocks = pool.withColumn("_b", F.floor(F.col("msg_id") / width))
    before = lambda w: F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = blocks.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_s", F.floor(F.col("_b") / width))
    inner = counts.select("_b", "_s", before(Window.partitionBy("_s").orderBy("_b")).alias("_in_stretch"))
    outer = counts.groupBy("_s").agg(F.sum("_n").alias("_n")).select(
        "_s", before(Window.orderBy("_s")).alias("_stretch"))
    offsets = inner.join(outer, "_s").select("_b", (F.col("_in_stretch") + F.col("_stretch")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("msg_id"))
    return blocks.withColumn("_r", rank).join(offsets, "_b").select(
        F.lit(name).alias("pool"), (F.col("_r") + F.col("_before") - 1).alias("number"),
        "msg_id", "risk_score")


def training_sequences(
    labelled: DataFrame, n_sequences: int, length: int = 5, seed: int = K.SEED,
) -> DataFrame:
    """Sampled turn sequences ``(seq_id, kind, target, pos, msg_id, risk_score)``.

    ``labelled``: ``msg_id, label, risk_score``.  Picks are modular hashes of
    (sequence, position), so every run and every engine draws the same messages.
    """
    spark = labelled.sparkSession
    fraud = labelled.filter(F.col("label") == K.FRAUDULENT)
    legit = labelled.filter(F.col("label") == K.LEGITIMATE)
    either = labelled.filter(F.col("label").isin(K.BINARY_LABELS))
    pools = _numbered(fraud, "fraud").unionByName(_numbered(legit, "legit")).unionByName(
        _numbered(either, "either"))
    sizes = pools.groupBy("pool").agg(F.count("*").alias("pool_size"))
    bounds, start = [], 0
    for kind, part in K.SEQUENCE_SHARES.items():
        size = max(1, int(n_sequences * part))
        bounds.append((kind, start, start + size))
        start += size
    kind = reduce(lambda acc, b: acc.when(F.col("seq_id") < b[2], b[0]), bounds[1:],
                  F.when(F.col("seq_id") < bounds[0][2], bounds[0][0]))
    draw = lambda a, b: F.pmod(
        (F.col("seq_id") * 7919 + a * 104_729 + seed) * 48_271 + b, F.lit(HASH_MODULUS))
    sequences = spark.range(start).select(F.col("id").alias("seq_id")).withColumn("kind", kind)
    # Rising risk is drawn four times as long and thinned after sorting.
    drawn = F.when(F.col("kind") == "escalation", 4 * length).otherwise(length)
    slots = sequences.withColumn("slot", F.explode(F.sequence(F.lit(0), drawn - 1)))
    opening = F.greatest(F.floor(
        length * (40 + F.pmod(draw(F.lit(1000), 17), F.lit(31))) / 100), F.lit(1))
    pool = (
        F.when(F.col("kind") == "all_legit", "legit").when(F.col("kind") == "all_fraud", "fraud")
        .when(F.col("kind") == "escalation", "either")
        .otherwise(F.when(F.col("slot") < opening, "legit").otherwise("fraud")))
    picks = slots.withColumn("pool", pool).join(F.broadcast(sizes), "pool").withColumn(
        "number", F.pmod(draw(F.col("slot"), 0), F.col("pool_size")))
    filled = picks.join(pools, ["pool", "number"])
    whole = filled.filter(F.col("kind") != "escalation").select(
        "seq_id", "kind", F.col("slot").alias("pos"), "msg_id", "risk_score")
    # One rising sequence has 4 * length draws: its sort is small.
    order = Window.partitionBy("seq_id").orderBy("risk_score", "slot")
    rising = filled.filter(F.col("kind") == "escalation").withColumn(
        "_r", F.row_number().over(order) - 1)
    half = max(2, length // 2)
    per_early, per_late = 2 * length // max(length - half, 1), 2 * length // half
    early = (F.col("_r") < 2 * length) & (F.col("_r") % per_early == 0) & (
        F.col("_r") / per_early < length - half)
    late = (F.col("_r") >= 2 * length) & ((F.col("_r") - 2 * length) % per_late == 0) & (
        (F.col("_r") - 2 * length) / per_late < half)
    pos = F.when(F.col("_r") < 2 * length, F.col("_r") / per_early).otherwise(
        length - half + (F.col("_r") - 2 * length) / per_late).cast("int")
    thinned = rising.filter(early | late).select(
        "seq_id", "kind", pos.alias("pos"), "msg_id", "risk_score")
    return whole.unionByName(thinned).withColumn(
        "target", (F.col("kind") != "all_legit").cast("int"))
