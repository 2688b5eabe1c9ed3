"""Windows, features, merge and paths against plain Python on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.levels import conversation_level
from riskloom.operators import conversations as C
from riskloom.operators import encoding as E

SUSPICIOUS = [
    "Buenas tardes, le habla su banco BBVA",
    "Detectamos un cargo urgente en su cuenta, debe verificar ahora",
    "Necesito su PIN y el código OTP para confirmar",
    "Si no responde su cuenta será bloqueada inmediatamente, multa",
]
HARMLESS = ["Hola, ¿cómo estás?", "Muy bien, gracias"]


def talk(spark, *texts_by_conv):
    rows = [(c, i, "x", t) for c, texts in enumerate(texts_by_conv) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id long, turn int, sender string, text string")


def test_summary_levels(spark):
    turns = talk(spark, SUSPICIOUS, HARMLESS)
    found = C.find_patterns(C.enrich(turns))
    got = {r.conv_id: r for r in C.summarize(turns, found).collect()}
    assert got[0].overall_risk in ("medium", "high", "critical") and got[0].patterns_found > 0
    assert got[1].overall_risk == "low" and got[1].overall_score == 0.0


def test_threshold_above_one_finds_nothing(spark):
    turns = talk(spark, SUSPICIOUS)
    assert C.find_patterns(C.enrich(turns), config={"candidate_threshold": 1.01}).count() == 0


def test_level_boundaries(spark):
    df = spark.createDataFrame([(0.80,), (0.60,), (0.35,), (0.0,)], "s double")
    assert [r.l for r in df.select(conversation_level(F.col("s")).alias("l")).collect()] == [
        "critical", "high", "medium", "low"]


def test_windows_of_a_long_conversation(spark):
    n = 200
    turns = talk(spark, [f"m{i}" for i in range(n)])
    got = {(r.a, r.b) for r in C.windows(turns, ["sender"]).select(
        F.col("win")[0]["turn"].alias("a"), F.element_at("win", -1)["turn"].alias("b")).collect()}
    assert got == {(s, s + w - 1) for w in K.WINDOW_SIZES for s in range(n - w + 1)}


def test_phrase_across_two_turns_counts_in_the_joined_half(spark):
    turns = talk(spark, ["hi", "hi", "act right", "now please"])
    feats = C.window_features(C.profile_turns(C.enrich(turns)), [4]).first()
    # "now" is inside a turn, "right now" only across the two late turns.
    assert feats.urgency_count == 1 and feats.urgency_late_ratio == 2.0


def merge_plain(spans, ratio):
    kept = []
    for s, e, x in sorted(spans, key=lambda t: (t[0], -t[2], t[1])):
        for i, (ks, ke, kx) in enumerate(kept):
            shared = max(0, min(e, ke) - max(s, ks) + 1)
            if shared / min(e - s + 1, ke - ks + 1) >= ratio:
                if x > kx:
                    kept[i] = (s, e, x)
                break
        else:
            kept.append((s, e, x))
    return sorted(kept)


@pytest.mark.parametrize("length", [12, 3000])
def test_merge_equals_a_plain_fold(spark, length):
    rng = random.Random(length)
    rows = []
    for conv in range(4):
        for name in ("impersonation", "financial_coercion"):
            seen = set()
            for _ in range(40):
                s, w = rng.randrange(length), rng.choice(K.WINDOW_SIZES)
                if (s, w) not in seen:
                    seen.add((s, w))
                    rows.append((conv, name, s, s + w - 1, round(rng.random(), 3)))
    df = spark.createDataFrame(
        rows, "conv_id long, pattern_type string, start_idx int, end_idx int, score double")
    got = {}
    for r in C.merge_spans(df).collect():
        got.setdefault((r.conv_id, r.pattern_type), []).append((r.start_idx, r.end_idx, r.rule_score))
    for key in {r[:2] for r in rows}:
        assert sorted(got[key]) == merge_plain([r[2:] for r in rows if r[:2] == key], 0.60)


def test_worst_path_is_the_top_turns_in_order(spark):
    turns = C.enrich(talk(spark, SUSPICIOUS, ["hola"])).withColumn("risk", F.col("risk_score") / 100.0)
    got = {r.conv_id: r for r in E.worst_path(turns, "risk", 2).collect()}
    risks = sorted((r.risk for r in turns.filter("conv_id = 0").collect()), reverse=True)
    assert len(got[0].path) == 2 and got[0].path == sorted(got[0].path)
    assert got[0].path_score == pytest.approx(sum(risks[:2]) / 2, abs=1e-4)
    assert got[1].path == [0] and got[1].escalation_start == 0


def test_risk_delta_crosses_block_borders(spark):
    texts = ["hola" if i % 2 else "URGENTE password http://a.com/x" for i in range(150)]
    rows = E.encode_turns(C.enrich(talk(spark, texts))).orderBy("turn").collect()
    assert len(rows) == 150
    for before, row in zip(rows, rows[1:]):
        assert row.risk_delta == pytest.approx(max(row.risk - before.risk, 0))
