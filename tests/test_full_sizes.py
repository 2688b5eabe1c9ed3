"""Registered queries run at the full sizes of their operators."""

from pyspark.sql import functions as F

from riskloom.operators import models, robustness
from riskloom.operators import cascade as J
from riskloom.plans import learning_queries, scoring_queries, tables


def _messages(spark):
    return spark.createDataFrame([(1, "urgent: verify your account now"), (2, "see you at lunch")],
                                 "msg_id long, message string")


def test_all_variants(spark, monkeypatch):
    monkeypatch.setattr(tables, "messages", lambda spark, folder: _messages(spark))
    counts = learning_queries.l1(spark, "").groupBy("msg_id").agg(F.countDistinct("variant").alias("n")).collect()
    assert sorted((r.msg_id, r.n) for r in counts) == [(1, 200), (2, 200)]
    assert {r.n_simulations for r in learning_queries.l2_l3(spark, "").collect()} == {200}


def test_all_models_and_rounds(monkeypatch):
    seen = []
    monkeypatch.setattr(tables, "labelled", lambda spark, folder: None)
    monkeypatch.setattr(models, "compare_models", lambda rows, names, *a, **b: seen.append((names, a, b)))
    monkeypatch.setattr(learning_queries, "_rounded", lambda df: df)
    learning_queries.g16(None, "")
    assert [list(names) for names, _, _ in seen] == [list(models.SUPPORTED)] and seen[0][1:] == ((), {})
    monkeypatch.setattr(models, "train", lambda rows, name, **b: seen.append((name, b)) or 1 / 0)
    try:
        learning_queries.QUERIES["g7_boosted_trees"](None, "")
    except ZeroDivisionError:
        assert seen[-1] == ("boosted_trees", {})


def test_sweep_sees_anomaly_scores(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0.9, 50, 0.5), (2, 0.1, 10, 0.2)],
                                 "msg_id long, cbr_score double, risk_score int, bayes_score double")
    monkeypatch.setattr(scoring_queries, "cascade_inputs", lambda spark, folder: rows)
    monkeypatch.setattr(scoring_queries, "anomaly_scores", lambda spark, folder: spark.createDataFrame(
        [(1, 0.7)], "msg_id long, anomaly_score double"), raising=False)
    monkeypatch.setattr(tables, "labels", lambda spark, folder: spark.createDataFrame(
        [(1, "fraudulent"), (2, "legitimate")], "msg_id long, label string"))
    monkeypatch.setattr(scoring_queries.sweep, "sweep_thresholds", lambda df: df)
    out = {r.msg_id: r.anomaly_score for r in scoring_queries._sweep(spark, "").collect()}
    assert out == {1: 0.7, 2: None} and set(J.OPTIONAL_SCORES) >= {"anomaly_score"}
