"""Fitted state as tables and model folders."""

import json
import re

from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    NaiveBayesModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.models import TrainedModel

MARKER = "committed"
_KINDS = {
    "naive_bayes": NaiveBayesModel, "logistic_regression": LogisticRegressionModel,
    "linear_svc": LinearSVCModel, "linear_svc_calibrated": LinearSVCModel,
    "random_forest": RandomForestClassificationModel, "boosted_trees": GBTClassificationModel,
}


def save_table(df: DataFrame, path: str, mode: str = "error") -> str:
    """Evidence tables, vocabularies, case bases, indexes, tree nodes, thresholds."""
    df.write.mode(mode).parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """Facts of every complete version; a version without its marker was never finished."""
    try:
        rows = spark.read.text(f"{folder}/v*/{MARKER}").select("value", F.input_file_name().alias("at")).collect()
    except AnalysisException:   # no such path
        return {}
    return {int(re.search(rf"/v(\d+)/{MARKER}/", r["at"])[1]): r["value"] for r in rows}


def save_model(trained: TrainedModel, folder: str) -> str:
    """Write a new version of a model; earlier ones stay. Its marker, written last, makes it visible."""
    spark = trained.vocabulary.sparkSession
    version = max(_versions(spark, folder), default=0) + 1
    path = f"{folder}/v{version}"
    trained.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    trained.model.write().overwrite().save(f"{path}/model")
    if trained.calibrator is not None:
        trained.calibrator.write().overwrite().save(f"{path}/calibrator")
    facts = {"name": trained.name, "width": trained.width, "manual": trained.manual,
             "calibrated": trained.calibrator is not None, "columns": trained.columns}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/{MARKER}")
    return path


def load_model(spark: SparkSession, folder: str, version: int | None = None) -> TrainedModel:
    """The latest complete version of a model, or the one that is asked for."""
    known = _versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete version {version or ''} in {folder}")
    version = max(known) if version is None else version
    facts, path = json.loads(known[version]), f"{folder}/v{version}"
    calibrator = LogisticRegressionModel.load(f"{path}/calibrator") if facts["calibrated"] else None
    return TrainedModel(
        facts["name"], _KINDS[facts["name"]].load(f"{path}/model"), spark.read.parquet(f"{path}/vocabulary"),
        facts["width"], facts["manual"], calibrator, facts["columns"])
