"""Searches, sweeps and scoring whose disk or work must not grow with pairs of rows."""

from functools import reduce
from operator import or_

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import models, nearest
from riskloom.plans import learning_queries
from riskloom.plans import scoring_queries as Q


def _vectors(spark, n, seed, width=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ids = np.sort(rng.choice(width, 6, replace=False))
        weights = rng.integers(1, 4, 6).astype(float)
        weights /= np.linalg.norm(weights)
        rows.append((i, int(i % 2), [int(x) for x in ids], [float(x) for x in weights]))
    rows.append((n, 0, [], []))
    rows.append((n + 1, 1, None, None))
    return rows, spark.createDataFrame(rows, "id long, item_label int, ids array<int>, weights array<double>")


def _dense(rows, width=60):
    out = np.zeros((len(rows), width))
    for i, (_, _, ids, weights) in enumerate(rows):
        out[i, ids or []] = weights or []
    return out


@pytest.mark.parametrize("shared", [True, False])
def test_best_items_over_many_blocks(spark, monkeypatch, shared):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nearest, "BLOCK_ENTRIES", 30)
    left, queries = _vectors(spark, 90, 1)
    right, items = _vectors(spark, 80, 2)
    right += [(200 + i, *right[0][1:]) for i in range(9)]   # copies tie, the lower id wins
    items = spark.createDataFrame(right, items.schema)
    found = nearest.block_neighbours(
        queries.selectExpr("id AS query_id", "ids", "weights"),
        items.withColumnRenamed("id", "item_id"), 4, shared=shared).collect()
    sims = np.round(_dense(left) @ _dense(right).T, 6)
    ids = np.array([r[0] for r in right])
    for i, row in enumerate(left):
        best = sorted((-sims[i, j], ids[j]) for j in range(len(right)) if sims[i, j] > 0 or not shared)[:4]
        got = sorted((-r.compared, r.item_id) for r in found if r.query_id == row[0])[:4]
        assert got == best


def test_search_shuffles_no_vectors(spark):
    _, df = _vectors(spark, 50, 3)
    found = nearest.block_neighbours(
        df.selectExpr("id AS query_id", "ids", "weights"), df.withColumnRenamed("id", "item_id"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_search_takes_null_keys_and_labels(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 1.0], None), (4, None, 1), (5, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in nearest.search_vectors(df.filter("vec_id is not null"), df).collect()}
    assert got[1].fraud_similarity == 1.0 and got[1].legit_similarity == 1.0
    assert got[2].fraud_similarity == 1.0 and got[2].legit_similarity == 0.0


@pytest.mark.parametrize("forest", [0.0, 1.0])
def test_sweeps_take_fitted_forest_scores(spark, monkeypatch, forest):
    rows = [(i, "legitimate", 0.7, 10, "low", 0.1, 0.1, 0.1, 0.1) for i in range(3, 43, 4)]   # no transformer
    inputs = spark.createDataFrame(
        rows, "msg_id long, predicted_class string, confidence double, risk_score int, model_level string, "
        "bayes_score double, cbr_score double, fraud_similarity double, legit_similarity double")
    monkeypatch.setattr(Q, "cascade_inputs", lambda *_: inputs)
    scores = inputs.selectExpr("msg_id", f"{forest}D AS anomaly_score")
    monkeypatch.setattr(Q, "anomaly_scores", lambda *_: scores.unionAll(scores))   # repeated ids add no rows
    monkeypatch.setattr(Q.T, "labels", lambda *_: inputs.selectExpr("msg_id", "'legitimate' AS label"))
    swept = Q.m1(spark, "").collect()
    assert {r.fp for r in swept} == {10 if forest else 0} and len(swept) > 1
    assert Q.m2(spark, "").count() == len(swept) and Q.m3_m5(spark, "").count() == 1


def test_character_classes_are_what_they_were(spark):
    """Same characters as the plain classes, whatever the flags; ASCII must be decided first."""
    every = spark.range(1, 0x3100).unionByName(spark.range(0xA600, 0xD800)).unionByName(spark.range(0xE000, 0x10000)) \
        .select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    plain = {K.S: f"[{K.SPACE}]", K.NS: f"[^{K.SPACE}]", f"[{K.WORD}]": r"[\p{L}\p{N}_]", f"[^{K.WORD}]": r"[^\p{L}\p{N}_]"}
    differ = [F.col("c").rlike(flags + new) != F.col("c").rlike(flags + old)
              for new, old in plain.items() for flags in ("", "(?iu)")]
    assert every.filter(reduce(or_, differ)).count() == 0
    assert K.NS.startswith("[!-~") and K.S.startswith("[[^!-~]") and K.WORD.startswith("a-zA-Z0-9_")


def test_state_round_trip_cleans_messages_once(spark, monkeypatch, tmp_path):
    cleaned = []
    scored, steps = models.score_messages, models.clean_steps
    monkeypatch.setattr(models, "score_messages", lambda *a: (cleaned.append(1), scored(*a))[1])
    monkeypatch.setattr(models, "clean_steps", lambda *a: (cleaned.append(1), steps(*a))[1])
    texts = ["urgente verify your password now", "hola nos vemos en casa", "", None]
    spark.createDataFrame([(i, texts[i % 4], "en", "s") for i in range(48)], "doc_id long, text string, lang string, source string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    out = learning_queries.a15(spark, str(tmp_path)).collect()
    assert len(out) == 48 and all(r.same_predicted_class and r.same_confidence and r.same_model_level for r in out)
    assert len(cleaned) == 2


def test_blocks_of_counted_terms_are_small_and_exact(spark):
    from riskloom.operators import tfidf
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = [(i, " ".join(rng.choice(words, int(n))), ["fraudulent", "legitimate"][i % 2])
             for i, n in enumerate(rng.integers(1, 200, 600))] + [(900, "", "legitimate"), (901, None, "fraudulent")]
    df = spark.createDataFrame(texts, "msg_id long, message string, label string").coalesce(1)
    vocabulary = tfidf.fit_tfidf(df, ngrams=(1, 1)).cache()
    parts = tfidf.transform_tfidf(df, vocabulary, ngrams=(1, 1), carry=["label"], unit=False).cache()
    whole = tfidf.transform_tfidf(df, vocabulary, ngrams=(1, 1), carry=["label"]).cache()
    entries = whole.selectExpr("sum(size(vector))").first()[0]
    side = nearest._sides(parts, "msg_id", "query_id")
    stored = nearest._blocks(side, "query_id").selectExpr("sum(length(codes) + length(ids) + length(weights))").first()[0]
    assert stored < entries * 12 / 3      # a plain entry takes twelve bytes
    # Rows of distinct weights are kept as they are.
    _, plain = _vectors(spark, 50, 3)
    kept = nearest._blocks(plain.selectExpr("id AS query_id", "ids", "weights"), "query_id").collect()
    assert sum(len(r["weights"]) for r in kept) <= 8 * 50 * 6
    found = [sorted(map(tuple, nearest.query_cases(v, nearest.build_cases(v), 5).collect())) for v in (parts, whole)]
    assert found[0] == found[1] and len(found[0]) == len(texts)


def test_texts_without_a_label_are_not_dealt(spark, tmp_path):
    from riskloom.plans import tables
    spark.sql("SELECT 1L AS doc_id, 'a' AS text, 'en' AS lang, 's' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT 1L AS doc_id, 1 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    plan = tables.labelled(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("Join")
