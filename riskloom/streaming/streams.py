"""Message streams: rule scoring, windowed alerts, rolling conversation risk."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions.rules import score_messages
from riskloom.session import scratch_path

LAST_TURNS = 8


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Files of one table as a stream; the schema comes from what is there."""
    path = f"{folder}/{table}.parquet"
    # The pattern matches a file as well as a folder of files; a stream takes no single file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a table of the shared folder; read it back."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option(
        "checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(
        path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latest_windows(counts: DataFrame, name: str) -> DataFrame:
    """Process all available input of a windowed count; every window with its last figures.

    Append mode keeps the newest windows back until later input closes them. Update mode
    shows each window as it stands: a batch is written under its number (a repeated
    batch replaces itself), and the last batch of a window holds.
    """
    spark = counts.sparkSession
    path = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    write(spark.createDataFrame([], counts.schema), -1)  # input without rows makes no batch
    counts.writeStream.outputMode("update").option(
        "checkpointLocation", f"{path}-progress").trigger(availableNow=True).foreachBatch(
        write).start().awaitTermination()
    schema = T.StructType([*counts.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in counts.columns if c not in ("start", "end")]
    last = F.max(F.struct("batch", *rest)).alias("m")
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").groupBy(
        "start", "end").agg(last).select("start", "end", *[f"m.{c}" for c in rest])


def score_stream(messages: DataFrame, text: str = "message") -> DataFrame:
    """Rules need no state, so a stream is scored like a table."""
    return score_messages(messages, text)


def alert_counts(
    scored: DataFrame, ts: str = "ts", length: str = "10 minutes", slide: str | None = None,
    late: str = "10 minutes",
) -> DataFrame:
    """Messages and high-risk messages per (sliding) window of event time."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return scored.withWatermark(ts, late).groupBy(window.alias("w")).agg(
        F.count("*").alias("n_messages"),
        F.sum((F.col("risk_level") != "low").cast("bigint")).alias("n_alerts"),
        F.max("risk_score").alias("max_score"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"),
             "n_messages", "n_alerts", "max_score")


_ROLLING = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()),
    T.StructField("n_turns", T.IntegerType()), T.StructField("mean_risk", T.DoubleType()),
    T.StructField("max_risk", T.IntegerType()), T.StructField("rise", T.IntegerType()),
])
_STATE = T.StructType([
    T.StructField("turns", T.ArrayType(T.IntegerType())),
    T.StructField("scores", T.ArrayType(T.IntegerType())),
])


def _roll(key, batches, state: GroupState):
    """Keep the last few turns of a conversation; the state never grows.

    The turns of a micro-batch are taken in their order, however they are cut into Arrow
    batches; what is held of them meanwhile are two numbers a turn.
    """
    turns, scores = state.get if state.exists else ([], [])
    held, out = list(zip(turns, scores)), []
    fresh = pd.concat([batch[["turn", "risk_score"]] for batch in batches])
    for turn, score in fresh.sort_values(["turn", "risk_score"]).itertuples(index=False):
        held = sorted([*held, (int(turn), int(score))])[-LAST_TURNS:]
        values = [s for _, s in held]
        out.append((key[0], int(turn), len(values), round(sum(values) / len(values), 4),
                    max(values), values[-1] - values[0]))
    state.update(([t for t, _ in held], [s for _, s in held]))
    yield pd.DataFrame(out, columns=[f.name for f in _ROLLING])


def rolling_risk(scored: DataFrame) -> DataFrame:
    """Mean, maximum and rise of risk over the last turns of every conversation."""
    return scored.select("conv_id", "turn", "risk_score").groupBy("conv_id").applyInPandasWithState(
        _roll, _ROLLING, _STATE, "append", GroupStateTimeout.NoTimeout)


# Task functions travel by value: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
