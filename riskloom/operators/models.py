"""Training and scoring of classifiers on TF-IDF plus hand-made features."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions import levels as L
from riskloom.functions.features import with_manual_features
from riskloom.functions.rules import score_messages
from riskloom.functions.text import clean_messages, clean_steps
from riskloom.operators import split, tfidf
from riskloom.session import scratch_dir, scratch_path, staged

SUPPORTED = [
    "naive_bayes", "logistic_regression", "linear_svc", "linear_svc_calibrated",
    "random_forest", "boosted_trees",
]
_ALIASES = {"xgboost": "boosted_trees", "lightgbm": "boosted_trees"}
CLASSES = [K.FRAUDULENT, K.LEGITIMATE]


def canonical_name(name: str) -> str:
    key = name.lower().replace("-", "_").replace(" ", "_")
    key = _ALIASES.get(key, key)
    if key not in SUPPORTED:
        raise ValueError(f"unsupported model {name!r}; choose from {SUPPORTED}")
    return key


def make_classifier(name: str, weighted: bool = True, **overrides):
    """Estimator with the usual settings; an override replaces a setting."""
    common = {"featuresCol": "features", "labelCol": "label_id"}
    if weighted:
        common["weightCol"] = "weight"
    kinds = {
        "naive_bayes": (NaiveBayes, {"smoothing": 1.0}),
        "logistic_regression": (LogisticRegression, {"maxIter": 100, "regParam": 0.001}),
        "linear_svc": (LinearSVC, {"maxIter": 100, "regParam": 0.001}),
        "linear_svc_calibrated": (LinearSVC, {"maxIter": 100, "regParam": 0.001}),
        "random_forest": (RandomForestClassifier, {"numTrees": 100, "seed": K.SEED}),
        "boosted_trees": (
            GBTClassifier, {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "minInstancesPerNode": K.LEAF_ROWS,
                            "cacheNodeIds": True, "checkpointInterval": 10, "seed": K.SEED}),
    }
    kind, defaults = kinds[canonical_name(name)]
    return kind(**{**common, **defaults, **overrides})


def as_feature_table(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """Write ``ids``/``values`` rows to the shared folder, read them as ML vectors.

    A sparse ML vector is stored as (type, size, indices, values), so the table
    can be read back with the vector type and no row passes through Python.
    Training iterates over the written table instead of the lineage of its text.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "features")
    df.select(*keep, F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col("ids").alias("indices"), F.col("values").alias("values"),
    ).alias("features")).write.parquet(path)
    fields = [df.schema[c] for c in keep] + [T.StructField("features", VectorUDT())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def sparse_features(
    cleaned: DataFrame, vocabulary: DataFrame, width: int, manual: bool, carry: list[str],
    text: str = "clean", key: str = "msg_id",
) -> DataFrame:
    """``(key, *carry, ids, values)``: TF-IDF, then the hand-made features from
    ``width`` on."""
    if not manual:
        vectors = tfidf.transform_tfidf(cleaned, vocabulary, key, text, carry=carry)
        return vectors.select(key, *carry, F.col("vector.term_id").alias("ids"),
                              F.col("vector.weight").alias("values"))
    extra = with_manual_features(cleaned.select(key, *dict.fromkeys([*carry, text])), text)
    packed = extra.withColumn("_manual", F.array(*K.MANUAL_FEATURES))
    vectors = tfidf.transform_tfidf(packed, vocabulary, key, text, carry=[*carry, "_manual"])
    places = F.array(*[F.lit(width + i) for i in range(len(K.MANUAL_FEATURES))])
    return vectors.select(
        key, *carry, F.concat("vector.term_id", places).alias("ids"),
        F.concat("vector.weight", "_manual").alias("values"))


def filled_columns(rows: DataFrame, least: int) -> list[int]:
    """Features that at least ``least`` rows fill, in order; bounded by the number of features.

    With no negative values a split sends empty rows one way, so a tree whose leaves hold
    ``least`` rows can't split by any other feature: leaving them out changes no tree.
    """
    filled = rows.select(F.explode(F.filter(F.arrays_zip("ids", "values"), lambda p: p["values"] != 0)).alias("_p"))
    counts = filled.groupBy(F.col("_p.ids").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return sorted(r["id"] for r in counts.select("id").collect())


def narrowed(rows: DataFrame, columns: list[int] | None, size: int) -> DataFrame:
    """``ids``/``values`` of the kept columns alone, numbered anew."""
    if columns is None:
        return rows
    place = np.full(size, -1, np.int32)
    place[columns] = np.arange(len(columns))
    at = F.lit(place)
    pairs = F.filter(F.transform(F.arrays_zip("ids", "values"), lambda p: F.struct(
        F.get(at, p["ids"]).alias("id"), p["values"].alias("value"))), lambda p: p["id"] >= 0)
    return rows.withColumn("_kept", pairs).withColumns({"ids": F.col("_kept.id"), "values": F.col("_kept.value")}).drop("_kept")


def sized(table: DataFrame, n: int) -> DataFrame:
    """A written table in as many partitions as ``n`` rows are worth, never more than it has."""
    return table.coalesce(max(1, n // K.TRAINING_ROWS))


@dataclass
class TrainedModel:
    """A fitted classifier with everything needed to score raw messages."""

    name: str
    model: object
    vocabulary: DataFrame
    width: int
    manual: bool
    calibrator: object = None
    columns: list[int] | None = None   # features that the model knows; None for all

    @property
    def size(self) -> int:
        return self.width + (len(K.MANUAL_FEATURES) if self.manual else 0)

    def features(self, cleaned: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """Feature table of messages that have a ``clean`` column."""
        carry = carry or []
        return self.table(sparse_features(cleaned, self.vocabulary, self.width, self.manual, carry), ["msg_id", *carry])

    def table(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Written feature table of ``ids``/``values`` rows."""
        return as_feature_table(narrowed(rows, self.columns, self.size), keep,
                                self.size if self.columns is None else len(self.columns))

    def original(self, at: int) -> int:
        """Number of a model feature among all features."""
        return at if self.columns is None else self.columns[at]

    def classify(self, features: DataFrame, keep: list[str]) -> DataFrame:
        """``(*keep, predicted_class, confidence, fraud_score)``."""
        raw = self.model.transform(features)
        margin = vector_to_array("rawPrediction")
        if self.calibrator is not None:
            scaled = raw.withColumn("margin", margin).drop(
                "prediction", "rawPrediction", "probability")
            raw = self.calibrator.transform(scaled.withColumn(
                "features", _one_vector("margin")))
        has_proba = "probability" in raw.columns
        values = vector_to_array("probability") if has_proba else vector_to_array("rawPrediction")
        at = F.col("prediction").cast("int")
        named = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), at + 1)
        confidence = F.element_at("_v", at + 1) if has_proba else F.array_max(
            F.transform("_v", F.abs))
        return raw.withColumn("_v", values).select(
            *keep, named.alias("predicted_class"), F.round(confidence, 4).alias("confidence"),
            F.round(F.element_at("_v", 1), 6).alias("fraud_score"))


def _one_vector(column: str) -> Column:
    return array_to_vector(F.slice(column, 2, 1))


def _calibrate(estimator, table: DataFrame, folds: int = 5):
    """One-feature logistic regression on out-of-fold margins."""
    held_out = None
    for i in range(folds):
        inner = table.withColumn("_fold", split.fold(F.col("msg_id"), folds))
        model = estimator.fit(inner.filter(F.col("_fold") != i))
        part = model.transform(inner.filter(F.col("_fold") == i)).select(
            "label_id", vector_to_array("rawPrediction").alias("margin"))
        held_out = part if held_out is None else held_out.unionByName(part)
    points = held_out.select("label_id", _one_vector("margin").alias("features"))
    return LogisticRegression(featuresCol="features", labelCol="label_id").fit(points)


class Prepared:
    """Labelled messages, cleaned, with their vocabulary; feature rows are written once for each kind."""

    def __init__(self, df: DataFrame, max_features: int = K.TFIDF_MAX_FEATURES):
        # Cleaned once, then read by the vocabulary fit and by the transform.
        cleaned = staged(
            clean_messages(df, "message", "clean").select("msg_id", "label", "clean"), "cleaned")
        self.width = max_features
        self.vocabulary = staged(
            tfidf.fit_tfidf(cleaned, text="clean", max_features=max_features), "vocabulary")
        self.targets = split.with_class_weight(split.encode_labels(cleaned)).withColumn(
            "label_id", F.col("label_id").cast("double"))
        self.n_rows = cleaned.count()
        self._rows: dict[bool, DataFrame] = {}

    def rows(self, manual: bool) -> DataFrame:
        if manual not in self._rows:
            self._rows[manual] = staged(sparse_features(
                self.targets, self.vocabulary, self.width, manual, ["label_id", "weight"]), "feature-rows")
        return self._rows[manual]


def fit(prepared: Prepared, name: str, manual: bool = True, **overrides) -> TrainedModel:
    """Fit a classifier on prepared messages."""
    key = canonical_name(name)
    manual = manual and key != "naive_bayes"
    trained = TrainedModel(key, None, prepared.vocabulary, prepared.width, manual)
    estimator = make_classifier(key, weighted=key != "naive_bayes", **overrides)
    rows = prepared.rows(manual)
    if key == "boosted_trees":
        trained.columns = filled_columns(rows, estimator.getMinInstancesPerNode())
    table = sized(trained.table(rows, ["msg_id", "label_id", "weight"]), prepared.n_rows)
    if key == "boosted_trees":
        scratch_dir(table.sparkSession)   # checkpoints of the node ids
    trained.model = estimator.fit(table)
    if key == "linear_svc_calibrated":
        trained.calibrator = _calibrate(estimator, table)
    return trained


def train(
    df: DataFrame, name: str = "logistic_regression", manual: bool = True,
    max_features: int = K.TFIDF_MAX_FEATURES, **overrides,
) -> TrainedModel:
    """Fit on labelled messages ``(msg_id, message, label)``."""
    canonical_name(name)
    return fit(Prepared(df, max_features), name, manual, **overrides)


def scored_texts(df: DataFrame, text: str = "message") -> DataFrame:
    """Messages with what no model changes: cleaned text and rule fields."""
    return score_messages(clean_steps(df, text, "clean"), text)


def predict_messages(trained: TrainedModel, df: DataFrame, text: str = "message") -> DataFrame:
    """Class, confidence, combined level, rule fields and advice per message.

    A message that is empty after cleaning is legitimate and low, without a
    confidence.
    """
    return predict_scored(trained, scored_texts(df, text))


def predict_scored(trained: TrainedModel, scored: DataFrame) -> DataFrame:
    """``predict_messages`` for rows of ``scored_texts``; only ``msg_id, clean, risk_level`` must be there."""
    carry = [c for c in scored.columns if c != "msg_id"]
    classes = trained.classify(trained.features(scored, carry), ["msg_id", *carry])
    return combine_with_rules(classes)


def combine_with_rules(df: DataFrame) -> DataFrame:
    """Expects ``clean, predicted_class, confidence`` and the rule columns."""
    empty = F.col("clean") == ""
    level = L.higher(L.label_level(F.col("predicted_class"), F.col("confidence")),
                     F.col("risk_level"))
    df = df.withColumn("model_level", F.when(empty, "low").otherwise(level))
    return df.withColumns({
        "predicted_class": F.when(empty, K.LEGITIMATE).otherwise(F.col("predicted_class")),
        "confidence": F.when(~empty, F.col("confidence")),
        "recommendation": L.recommendation(F.col("model_level")),
    })


def feature_importance(trained: TrainedModel, top: int = 20) -> DataFrame:
    """Importance per named feature of a tree model."""
    spark = trained.vocabulary.sparkSession
    weights = trained.model.featureImportances
    rows = [(trained.original(int(i)), float(v)) for i, v in zip(weights.indices, weights.values)]
    table = spark.createDataFrame(rows, "term_id int, importance double")
    return _named(table, trained).orderBy(F.desc("importance"), "feature").limit(top)


def coefficients(trained: TrainedModel) -> DataFrame:
    """``(feature, term_id, coefficient)`` of a linear model, fraud positive."""
    spark = trained.vocabulary.sparkSession
    # Class 1 is legitimate, so the sign is turned round.
    rows = [(i, -float(v)) for i, v in enumerate(trained.model.coefficients.toArray())]
    return _named(spark.createDataFrame(rows, "term_id int, coefficient double"), trained)


def _named(table: DataFrame, trained: TrainedModel) -> DataFrame:
    """Replace feature numbers by names; the table has one row per feature."""
    manual = F.array(*[F.lit(n) for n in K.MANUAL_FEATURES])
    names = trained.vocabulary.select("term_id", "term")
    return table.join(F.broadcast(names), "term_id", "left").withColumn(
        "feature", F.coalesce("term", F.get(manual, F.col("term_id") - trained.width)),
    ).drop("term").filter(F.col("feature").isNotNull())


def compare_models(
    df: DataFrame, names: list[str], overrides: dict[str, dict] | None = None, **options,
) -> DataFrame:
    """Test metrics of several models on one stratified split."""
    from riskloom.operators.metrics import binary_metrics
    parts = staged(split.stratified_split(df), "split")
    prepared = Prepared(parts.filter(~F.col("is_test")), options.pop("max_features", K.TFIDF_MAX_FEATURES))
    cleaned = staged(clean_steps(parts.filter("is_test"), "message", "clean").select("msg_id", "label", "clean"), "tested")
    tested, result = {}, None
    for name in names:
        trained = fit(prepared, name, **options, **(overrides or {}).get(name, {}))
        if trained.manual not in tested:
            tested[trained.manual] = staged(sparse_features(
                cleaned, trained.vocabulary, trained.width, trained.manual, ["label"]), "tested-rows")
        classes = trained.classify(trained.table(tested[trained.manual], ["msg_id", "label"]), ["msg_id", "label"])
        row = binary_metrics(
            classes, "label", "predicted_class", K.FRAUDULENT).withColumn("model", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result
