"""Scorers, metrics, sampling and files on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import (
    anomaly, bayes, cascade, metrics, nearest, ranking, robustness, split, tfidf,
)
from riskloom.sources import conversations as talks
from riskloom.sources import files


def table(spark, n=60):
    fraud = ["urgente verifique su cuenta bancaria password {}", "ganó un premio reclame ahora {}"]
    legit = ["hola nos vemos mañana en casa {}", "gracias por la comida de ayer {}"]
    rows = [(i, (fraud if i % 3 == 0 else legit)[i % 2].format(f"w{i % 5}"),
             "fraudulent" if i % 3 == 0 else "legitimate") for i in range(n)]
    return spark.createDataFrame(rows, "msg_id long, message string, label string")


def test_tfidf_matches_plain_python(spark):
    docs = {1: "uno dos dos tres", 2: "dos tres é", 3: "tres cuatro", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "msg_id long, message string")
    vocabulary = tfidf.fit_tfidf(df, ngrams=(1, 2), min_df=1)
    idf = {r.term: r.idf for r in vocabulary.collect()}
    assert idf["tres"] == pytest.approx(math.log(5 / 4) + 1)
    assert {"dos dos", "dos tres", "uno dos"} <= idf.keys() and "e" not in idf
    rows = {r.msg_id: r.vector for r in tfidf.transform_tfidf(df, vocabulary, ngrams=(1, 2)).collect()}
    assert rows[4] == []
    assert all(sum(x.weight ** 2 for x in rows[i]) == pytest.approx(1) for i in (1, 2, 3))


def test_exact_sample_sizes(spark):
    df = spark.range(5000).select(
        F.col("id").alias("msg_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("label"))
    parts = split.stratified_split(df).groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n"))
    assert {r.label: r.n for r in parts.collect()} == {"a": 100, "b": 900}
    few = ranking.hash_sample(df, "label", "msg_id", F.lit(7), 1, "s").filter("s")
    assert few.count() == 14


def test_auc_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.3, round(rng.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    plain = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, F.col("y"), "s").first().auc == pytest.approx(plain)


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([("fraudulent", "legitimate")], "label string, p string")
    row = metrics.binary_metrics(df, "label", "p", "fraudulent").first()
    assert (row.precision, row.recall, row.f1_score) == (0.0, 0.0, 0.0)


def test_bayes_orders_messages(spark):
    model = bayes.fit_evidence(table(spark))
    df = spark.createDataFrame(
        [(1, "urgente verifique su cuenta password"), (2, "hola nos vemos")], "msg_id long, message string")
    scores = {r.msg_id: r.bayes_score for r in bayes.score_messages(df, model).collect()}
    assert 0 <= scores[2] < scores[1] <= 1


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(150, 8)).round(3)
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    for r in nearest.search_vectors(df, df).collect():
        order = sorted(range(150), key=lambda j: (-round(sims[r.vec_id, j], 6), j))[:5]
        assert [n.vec_id for n in r.top_neighbors] == order
        own = [j for j in range(150) if j % 3 == 1]
        assert r.fraud_similarity == pytest.approx(sims[r.vec_id, own].max(), abs=1e-4)


def test_cases_prefer_their_class(spark):
    df = table(spark)
    vocabulary = tfidf.fit_tfidf(df)
    vectors = tfidf.transform_tfidf(df, vocabulary, carry=["label"])
    got = nearest.query_cases(vectors, nearest.build_cases(vectors)).join(df, "msg_id").collect()
    assert all((r.cbr_score > 0.5) == (r.label == "fraudulent") for r in got)
    assert all(r.most_similar <= 1.0 and len(r.top_k_labels) <= 7 for r in got)


def test_anomaly_scores(spark):
    rows = [(i, f"hola nos vemos en la casa numero {i % 4} de la calle", False) for i in range(48)]
    df = spark.createDataFrame([*rows, (99, "", True)], "msg_id long, clean string, is_blank boolean")
    train = df.filter("msg_id < 48")
    vocabulary = tfidf.fit_tfidf(train, text="clean", ngrams=(1, 2))
    vectors = tfidf.transform_tfidf(df, vocabulary, text="clean", ngrams=(1, 2), carry=["is_blank"])
    known = vectors.filter("msg_id < 48")
    got = {r.msg_id: r.anomaly_score for r in anomaly.score_forest(
        vectors, anomaly.fit_forest(known, trees=20), known).collect()}
    assert got[99] == 0.0 and all(0 <= s <= 1 for s in got.values())
    with pytest.raises(ValueError):
        anomaly.score_forest(vectors, anomaly.fit_forest(known, trees=2), known.limit(3))


@pytest.mark.parametrize("label,conf,rule,over,expected", [
    ("fraudulent", 0.99, 70, {}, True), ("fraudulent", 0.99, 70, {"rule_fraud_min": 100}, False),
    ("legitimate", 0.99, 5, {}, True), ("legitimate", 0.99, 20, {}, False),
])
def test_gate_one(spark, label, conf, rule, over, expected):
    df = spark.createDataFrame([(1, label, conf, rule, "low")],
                               "msg_id long, predicted_class string, confidence double, risk_score int, model_level string")
    assert cascade.with_gates(df, over).first().gate1 is expected
    with pytest.raises(ValueError):
        cascade.settings({"no_such_setting": 1})


def test_variants_are_never_empty_and_repeatable(spark):
    df = spark.createDataFrame([(1, "URGENTE verifique su cuenta ahora"), (2, "a"), (3, "hola amigo")],
                               "msg_id long, message string")
    one = robustness.perturb(df, 40).collect()
    assert one == robustness.perturb(df, 40).collect() and len(one) == 120
    assert all(r.message.strip() for r in one) and len({r.kind for r in one}) == 5
    stats = robustness.stability(df, 40).collect()
    assert all(r.ci_low <= r.mean_score + 1e-9 and 0 <= r.stability <= 1 for r in stats)


def test_disguises_keep_and_lower(spark):
    df = spark.createDataFrame([(1, "Urgent: verify your password now", "fraudulent")],
                               "msg_id long, message string, label string")
    got = {r.kind: r.message for r in robustness.disguise(df).collect()}
    assert set(got) == set(robustness.DISGUISES) and "verify your password" in got["dilution"]
    assert "-" in got["hyphen"] and got["lookalike"] != "Urgent: verify your password now"
    assert all(r.variant_score < r.original_score for r in robustness.evading(df).collect())


def test_files_with_headers_aliases_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Category,Body,extra\nham,"hola, tú",1\nspam,gana ya,2\nodd,zzz,3\nham,  ,4\n', encoding="utf-8")
    (tmp_path / "b.tsv").write_bytes("v1\tSMS\nspam\tcontraseña\n".encode("latin-1"))
    (tmp_path / "c.txt").write_text("ham\tnos vemos\nspam\tpremio\n")
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    got = {(r.source, r.message, r.label) for r in files.load_folder(spark, str(tmp_path)).collect()}
    assert got == {
        ("a", "hola, tú", "legitimate"), ("a", "gana ya", "fraudulent"), ("b", "contraseña", "fraudulent"),
        ("c", "nos vemos", "legitimate"), ("c", "premio", "fraudulent")}
    out = files.prepare(spark, str(tmp_path), str(tmp_path / "out"), "csv")
    assert out.count() == 5 and files.validate(out)
    assert files.load_unlabelled(spark, str(tmp_path / "c.txt")).count() == 2


def test_conversation_json_items(spark, tmp_path):
    (tmp_path / "t.json").write_text('["hola", {"text": "x", "sender": "s", "timestamp": "t1"}, {}]')
    rows = talks.read_json(spark, str(tmp_path / "t.json")).orderBy("turn").collect()
    assert [(r.turn, r.text, r.sender, r.ts) for r in rows] == [
        (0, "hola", "unknown", None), (1, "x", "s", "t1"), (2, "", "unknown", None)]
    lines = spark.createDataFrame([(1, "a\n\n  \n b \n")], "conv_id long, text string")
    assert [r.text for r in talks.parse_lines(lines).orderBy("turn").collect()] == ["a", "b"]


def test_class_weights(spark):
    got = {r.label: r.weight for r in split.class_weights(table(spark)).collect()}
    assert got["fraudulent"] == pytest.approx(60 / (2 * 20)) and K.BINARY_LABELS[1] in got
