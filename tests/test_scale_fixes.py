"""Cases that small tables do not show: long conversations, gaps, equal rows, last windows."""

import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import conversations as C
from riskloom.operators import tfidf
from riskloom.operators.ranking import stable_hash
from riskloom.plans import learning_queries as Q
from riskloom.sources import files
from riskloom.streaming import streams


def _talk(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_long_conversations_keep_their_turn_numbers(spark, tmp_path):
    folder = _talk(spark, tmp_path, [(1, i, "user", f"t{i}") for i in range(2500)])
    turns = Q.a10(spark, folder)
    assert turns.filter(F.concat(F.lit("t"), "turn") != F.col("text")).count() == 0
    assert turns.select("turn").distinct().count() == 2500


@pytest.mark.parametrize("numbers", [range(200), range(1, 201), [i for i in range(9000, 9222) if i % 10]])
def test_windows_with_any_turn_numbers(spark, numbers):
    numbers = list(numbers)
    rows = spark.createDataFrame([(1, t, 5) for t in numbers], "conv_id long, turn int, risk_score int")
    found = C.windows(rows, ["risk_score"], [2, 4]).select(F.transform("win", lambda w: w["turn"]).alias("w"))
    expected = sorted(numbers[i:i + n] for n in (2, 4) for i in range(len(numbers) - n + 1))
    assert sorted(r.w for r in found.collect()) == expected


def test_every_row_has_its_own_id(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "message string, label string")
    numbered = files.with_message_ids(rows)
    assert numbered.select("msg_id").distinct().count() == 3
    assert sorted(numbered.collect()) == sorted(numbered.collect())


def test_hash_of_large_ids(spark):
    keys = spark.createDataFrame([(3 * 10**14,), (9 * 10**18,), (5,)], "k long")
    values = [r.h for r in keys.select(stable_hash(F.col("k"), 42).alias("h")).collect()]
    assert values == [(k * 48271 + 42 * 69621) % 2_147_483_647 for k in (3 * 10**14, 9 * 10**18, 5)]


def test_alert_windows_are_all_there(spark, tmp_path):
    folder = _talk(spark, tmp_path, [(c, t, "user", "urgent, send your pin now") for c in range(40) for t in range(3)])
    out = Q.p2(spark, folder)
    assert out.agg(F.sum("n_messages")).first()[0] == 120
    assert out.count() == out.select("start").distinct().count()


def test_tfidf_transform_has_no_exchange(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 7} other words here") for i in range(200)], "msg_id long, message string") \
        .repartition(20).write.parquet(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    vocabulary = tfidf.fit_tfidf(rows, min_df=1)
    vectors = tfidf.transform_tfidf(rows, vocabulary, carry=["message"])
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    assert vectors.filter(F.size("vector") == 0).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "unknownword")], "msg_id long, message string")
    assert [r.vector for r in tfidf.transform_tfidf(nothing, vocabulary).collect()] == [[], []]


def test_scratch_folder_must_be_shared(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda **_: pytest.fail("a local folder was made"))
    with pytest.raises(RuntimeError):
        session.scratch_dir(Session())


def test_latest_windows_of_several_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1_700_000_000 + 60 * k, 10 * k)], "s long, risk_score int").selectExpr(
            "timestamp_seconds(s) AS ts", "risk_score", "'low' AS risk_level").write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, risk_score int, risk_level string").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.latest_windows(streams.alert_counts(stream, length="1 day"), "w").collect()
    assert [(r.n_messages, r.max_score) for r in out] == [(3, 20)]
