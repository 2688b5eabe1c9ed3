"""Saved models, merged spans, rolling risk, variant scores, parameter search."""

import itertools
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import conversations as C
from riskloom.operators import models, robustness, sweep
from riskloom.sources import files, state
from riskloom.streaming import streams


@pytest.fixture(scope="module")
def messages(spark):
    random.seed(1)
    bad = ["urgent verify your account now", "you won a prize claim the reward", "send the pin and password today"]
    good = ["see you at lunch tomorrow", "the report is on the table", "thanks for the nice photos"]
    rows = [(i, random.choice(bad if i % 2 else good) + f" note {i % 5}", K.FRAUDULENT if i % 2 else K.LEGITIMATE)
            for i in range(120)]
    return spark.createDataFrame(rows, "msg_id long, message string, label string")


@pytest.mark.parametrize("name", ["boosted_trees", "linear_svc_calibrated"])
def test_saved_models_score_like_themselves(spark, messages, tmp_path, name):
    settings = {"maxIter": 2} if name == "boosted_trees" else {}
    trained = models.train(messages, name, **settings)
    first = state.save_model(trained, str(tmp_path / "m"))
    assert first.endswith("/v1")
    again = state.load_model(spark, str(tmp_path / "m"))
    scores = [sorted(map(tuple, models.predict_messages(m, messages).select(
        "msg_id", "predicted_class", "confidence").collect())) for m in (trained, again)]
    assert scores[0] == scores[1] and sum(p == (K.FRAUDULENT if i % 2 else K.LEGITIMATE) for i, p, _ in scores[0]) > 110


def test_versions_without_marker_do_not_exist(spark, messages, tmp_path):
    folder = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        state.load_model(spark, folder)
    one = models.train(messages, "logistic_regression")
    assert state.save_model(one, folder).endswith("/v1") and state.save_model(one, folder).endswith("/v2")
    spark.range(1).write.parquet(f"{folder}/v3/vocabulary")   # a writer that was lost
    assert max(state._versions(spark, folder)) == 2
    with pytest.raises(FileNotFoundError):
        state.load_model(spark, folder, 3)
    assert state.load_model(spark, folder, 1).name == "logistic_regression"


def test_narrow_tables_grow_the_same_trees(spark, messages):
    prepared = models.Prepared(messages)
    narrow = models.fit(prepared, "boosted_trees", maxIter=2)
    assert 0 < len(narrow.columns) < narrow.size
    wide = models.make_classifier("boosted_trees", maxIter=2).fit(models.sized(models.as_feature_table(
        prepared.rows(True), ["msg_id", "label_id", "weight"], narrow.size), 120))
    used = {narrow.original(int(i)): v for i, v in zip(
        narrow.model.featureImportances.indices, narrow.model.featureImportances.values, strict=True)}
    full = dict(zip(map(int, wide.featureImportances.indices), wide.featureImportances.values, strict=True))
    assert used == pytest.approx(full)


def test_search_halves_and_keeps_the_best(spark, messages):
    prepared = models.Prepared(messages)
    points = sweep.boosting_points(4)
    assert all(len({p[n] for p in points}) == 4 for n in K.BOOSTING_BOUNDS)
    points = [{**p, "maxIter": 50, "maxDepth": 2, "minInstancesPerNode": 5 + i} for i, p in enumerate(points)]
    out = sweep.search_boosting(prepared.rows(True), prepared.width + len(K.MANUAL_FEATURES), points,
                                folds=3, rounds=(2, 4), keep=2).collect()
    assert sorted((r.stage, r.rounds) for r in out) == [(0, 2), (0, 2), (1, 4), (2, 50)]
    assert all(0 <= r.f1_score <= 1 for r in out) and max(r.f1_score for r in out) > 0.9
    with pytest.raises(ValueError):
        sweep.search_boosting(prepared.rows(True), prepared.width, [{**points[0], "stepSize": 0.9}])


def plain_merge(spans, ratio):
    kept = []
    for start, score, end in sorted((s, -p, e) for s, e, p in spans):
        new = [start, end, -score]
        for k in kept:
            shared = max(min(k[1], end) - max(k[0], start) + 1, 0)
            if shared / (min(k[1] - k[0], end - start) + 1) >= ratio:
                if new[2] > k[2]:
                    k[:] = new
                break
        else:
            kept.append(new)
    return sorted(map(tuple, kept))


@pytest.mark.parametrize("ratio", [0.3, 0.5, 1.0])
def test_spans_merge_like_a_plain_fold(spark, ratio):
    random.seed(int(10 * ratio))
    rows = [(c, p, s, s + random.choice([1, 2, 4, 7]), round(random.random(), 2))
            for c in range(6) for p in ("a", "b") for s in sorted(random.choices(range(60), k=random.choice([1, 8, 40])))]
    rows += [(9, "a", 5, 7, 0.5)] * 3
    out = C.merge_spans(spark.createDataFrame(
        rows, "conv_id long, pattern_type string, start_idx int, end_idx int, score double"), ratio).collect()
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[:2]):
        own = [(r.start_idx, r.end_idx, r.rule_score) for r in out if (r.conv_id, r.pattern_type) == key]
        assert sorted(own) == plain_merge([r[2:] for r in group], ratio)
    assert C.merge_spans(spark.createDataFrame([], "conv_id long, pattern_type string, start_idx int, end_idx int, score double")).collect() == []


def test_a_long_island_takes_linear_time(spark):
    rows = spark.range(100_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.lit("a").alias("pattern_type"), F.col("id").cast("int").alias("start_idx"),
        (F.col("id") + 7).cast("int").alias("end_idx"), (F.col("id") % 101 / 101.0).alias("score"))
    start = time.time()
    n = C.merge_spans(rows).count()
    assert n == 991 and time.time() - start < 60  # one for every rise of the scores


def test_rolling_risk_is_the_same_for_any_cut_into_batches():
    random.seed(4)
    rows = pd.DataFrame({"turn": range(40), "risk_score": [random.randrange(100) for _ in range(40)]}).sample(frac=1, random_state=1)

    class State:
        exists = False

        def update(self, value):
            self.value = value

    results = []
    for size in (1, 7, 40):
        held = State()
        cut = iter([rows.iloc[i:i + size] for i in range(0, 40, size)])
        results.append((pd.concat(streams._roll((1,), cut, held)).values.tolist(), held.value))
    assert results[0] == results[1] == results[2] and len(results[0][0]) == 40
    assert [r[1] for r in results[0][0]] == list(range(40))


def test_variant_scores_equal_scores_of_the_texts(spark):
    random.seed(5)
    parts = ["urgent", "URGENTE", "act", "now", "right", "away", "verify", "pin", "the", "a", "$", "500", "pesos", "5,000",
             "555", "123", "4567", "+52", "(55)", "1234", "5678.", "12a34567", "x@y.com", "www.a.b", "bit.ly/x", "shop.com/a",
             "prize!", "!!", "ß", "İstanbul", "congratulations", "you", "won", "bank", "transfer", "password", "\n", "  ", "final", "notice"]
    rows = [(i, " ".join(random.choices(parts, k=random.choice([0, 1, 2, 3, 5, 9, 30])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "act\nnow"), (904, "555 1234"), (905, "send 5 5 5 1 2 3 4 now")]
    df = spark.createDataFrame(rows, "msg_id long, message string")
    quick = robustness.variant_scores(df, 60).select("msg_id", "variant", "risk_score", "is_fraud")
    whole = robustness.rule_scorer(robustness.perturb(df, 60)).select("msg_id", "variant", "risk_score", "is_fraud")
    assert quick.exceptAll(whole).count() == 0 and whole.exceptAll(quick).count() == 0


def test_many_delimited_files_are_one_scan(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i:03}.csv").write_text(f'Category,SMS\nspam,"line one\nline ""two"" {i}"\nham, hello {i} \nother,x\nham,\n')
    rows = files.load_delimited(spark, str(tmp_path / "*.csv"), ",")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    found = sorted(map(tuple, rows.collect()))
    assert found == sorted([(f'line one\nline "two" {i}', K.FRAUDULENT) for i in range(40)]
                           + [(f" hello {i} ", K.LEGITIMATE) for i in range(40)])
