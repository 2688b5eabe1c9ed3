"""Queries over training, evaluation, explanation, robustness, streams, files."""

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import levels as L
from riskloom.functions.features import with_manual_features
from riskloom.functions.rules import score_messages
from riskloom.functions.text import clean_messages, clean_steps
from riskloom.operators import (
    explain, metrics, models, profile, robustness, split, stacking, sweep, tfidf,
)
from riskloom.operators import cascade as J
from riskloom.operators import conversations as C
from riskloom.operators import encoding as E
from riskloom.plans import tables as T
from riskloom.plans.scoring_queries import anomaly_scores, cascade_inputs, cleaned_cases
from riskloom.session import scratch_path, staged
from riskloom.sources import conversations as talks
from riskloom.sources import files, state
from riskloom.streaming import streams


def predictions(spark, folder):
    """Rule-based predictions of the labelled messages."""
    scored = score_messages(T.messages(spark, folder)).select("msg_id", "risk_score")
    return scored.join(T.labels(spark, folder), "msg_id").select(
        "msg_id", "label", (F.col("risk_score") / 100.0).alias("score"),
        F.when(F.col("risk_score") >= K.SCORE_MEDIUM, K.FRAUDULENT).otherwise(
            K.LEGITIMATE).alias("predicted"))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def a5(spark, folder):
    raw = T.read(spark, folder, "labels").select("doc_id", F.when(
        F.col("toxic") == 1, " Spam ").when(F.col("quality") == 1, "HAM").otherwise("other").alias("label"))
    return files.normalize_labels(raw)


def a6(spark, folder):
    return files.drop_blank(T.messages(spark, folder)).select("msg_id", "source")


def a11(spark, folder):
    docs = T.messages(spark, folder).select(F.col("msg_id").alias("conv_id"), F.col("message").alias("text"))
    return talks.parse_lines(docs)


def a10(spark, folder):
    """Conversations written as JSON arrays of up to 1,000 turns, then parsed back."""
    part = F.struct("conv_id", F.floor(F.col("turn") / 1000).alias("part"))
    packed = T.turns(spark, folder).groupBy(part.alias("key")).agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "text", "sender"))),
        lambda m: m.dropFields("turn"))).alias("value"))
    return talks.parse_json(packed, key="key").select(
        "key.conv_id", (F.col("key.part") * 1000 + F.col("turn")).cast("int").alias("turn"), "sender", "text")


def g1(spark, folder):
    return split.encode_labels(T.labels(spark, folder)).select("msg_id", "label", "label_id")


def g2(spark, folder):
    return split.stratified_split(T.labels(spark, folder)).select(
        "msg_id", "label", F.col("is_test").cast("int").alias("is_test"))


def g8(spark, folder):
    return _rounded(split.class_weights(T.labels(spark, folder)))


def g10(spark, folder):
    return metrics.confusion_matrix(predictions(spark, folder), "label", "predicted", models.CLASSES)


def g11(spark, folder):
    return _rounded(metrics.binary_metrics(predictions(spark, folder), "label", "predicted", K.FRAUDULENT))


def g12(spark, folder):
    return _rounded(metrics.class_metrics(predictions(spark, folder), "label", "predicted")).drop("hit", "called")


def g13(spark, folder):
    return _rounded(metrics.classification_report(predictions(spark, folder), "label", "predicted"))


def g14(spark, folder):
    return _rounded(metrics.roc_auc(predictions(spark, folder), F.col("label") == K.FRAUDULENT, "score"))


def g15(spark, folder):
    return metrics.errors(predictions(spark, folder), "label", "predicted", K.FRAUDULENT)


def _trained(name):
    def run(spark, folder):
        trained = models.train(T.labelled(spark, folder), name)
        return models.predict_messages(trained, T.messages(spark, folder)).select(
            "msg_id", "predicted_class", "confidence", F.col("model_level").alias("risk_level"),
            "risk_score", "recommendation")
    return run


def g16(spark, folder):
    return _rounded(models.compare_models(T.labelled(spark, folder), models.SUPPORTED))


def g17(spark, folder):
    rows = T.labelled(spark, folder)
    both = models.compare_models(rows, ["logistic_regression"]).withColumn("manual", F.lit(True))
    return _rounded(both.unionByName(models.compare_models(
        rows, ["logistic_regression"], manual=False).withColumn("manual", F.lit(False))))


def h2_h4(spark, folder):
    rows = cascade_inputs(spark, folder)
    own = L.label_level(F.col("predicted_class"), F.col("confidence"))
    return rows.select("msg_id", own.alias("class_level"), F.col("model_level").alias("risk_level"),
                       L.recommendation(F.col("model_level")).alias("recommendation"))


def i6(spark, folder):
    return anomaly_scores(spark, folder).withColumn("is_anomalous", F.col("anomaly_score") >= K.CASCADE_DEFAULTS["anomaly_boost_thr"])


def j8(spark, folder):
    rows = J.meta_features(J.with_gates(cascade_inputs(spark, folder))).join(
        T.labels(spark, folder), "msg_id")
    return stacking.fit_meta(rows)[1]


def k18(spark, folder):
    scored = score_messages(T.messages(spark, folder)).select("msg_id", "risk_score").join(
        T.labels(spark, folder), "msg_id")
    texts = T.messages(spark, folder).select("msg_id", F.col("message").alias("text"))
    sample = E.training_sequences(staged(scored, "scored"), 5000)
    model = stacking.fit_window_model(stacking.sequence_features(sample, texts))
    rows = C.enrich(T.turns(spark, folder))
    features = staged(C.window_features(C.profile_turns(rows)), "features")
    return C.find_patterns(rows, model_scores=stacking.window_scores(model, features))


def l1(spark, folder):
    return robustness.perturb(T.messages(spark, folder))


def l2_l3(spark, folder):
    return robustness.stability(T.messages(spark, folder))


def l4(spark, folder):
    return robustness.disguise(T.messages(spark, folder))


def l5(spark, folder):
    return robustness.evading(T.labelled(spark, folder)).select(
        "msg_id", "kind", "label", "original_score", "variant_score")


def m4(spark, folder):
    prepared = models.Prepared(T.labelled(spark, folder))
    return _rounded(sweep.search_boosting(
        prepared.rows(True), prepared.width + len(K.MANUAL_FEATURES), sweep.boosting_points(9)))


def a1_a9(spark, folder):
    """A table written as delimited files of several kinds, read back, validated and written again."""
    target = scratch_path(spark, "raw")
    raw = T.labelled(spark, folder).select(
        "source", F.when(F.col("label") == K.FRAUDULENT, "Spam").otherwise(" HAM ").alias("Category"),
        F.col("message").alias("SMS"))
    kinds = {"comma": ("coalesce(source, '') < 'src2'", ","), "tab": ("coalesce(source, '') >= 'src2'", "\t")}
    for name, (part, sep) in kinds.items():
        raw.filter(part).drop("source").write.option("header", True).option("sep", sep).option("quoteAll", True) \
            .option("escape", '"').option("lineSep", "\n").csv(f"{target}/{name}")
    tables = [files.load_delimited(spark, f"{target}/{name}/*.csv", sep).withColumn("source", F.lit(name))
              for name, (_, sep) in kinds.items()]
    rows = tables[0].unionByName(tables[1])
    files.validate(rows)
    written = scratch_path(spark, "processed")
    files.save_processed(rows, written)
    return spark.read.parquet(written).select(
        "source", "label", F.md5("message").alias("message_md5"), F.length("message").alias("n_chars"))


def a15(spark, folder):
    """Scores of a saved and reloaded model beside those of the model itself."""
    trained = models.train(T.labelled(spark, folder), "logistic_regression")
    target = scratch_path(spark, "state")
    state.save_model(trained, target)
    again = state.load_model(spark, target)
    # Texts are cleaned and scored by the rules once, for both models.
    scored = staged(models.scored_texts(T.messages(spark, folder)).select("msg_id", "clean", "risk_level"), "scored")
    rows = [models.predict_scored(m, scored).select(
        "msg_id", "predicted_class", "confidence", "model_level") for m in (trained, again)]
    return rows[0].join(rows[1], "msg_id").select(
        "msg_id", *[rows[0][c].eqNullSafe(rows[1][c]).alias(f"same_{c}")
                    for c in ("predicted_class", "confidence", "model_level")])


def _linear(spark, folder):
    """Difference of class means stands in for fitted coefficients."""
    rows = with_manual_features(T.labelled(spark, folder)).select("msg_id", "label", *K.MANUAL_FEATURES)
    long = explain.long_features(staged(rows, "features"), K.MANUAL_FEATURES)
    both = long.join(T.labels(spark, folder), "msg_id")
    mean = lambda c: F.avg(F.when(F.col("label") == c, F.col("value")))
    weights = both.groupBy("feature").agg(
        F.round(mean(K.FRAUDULENT) - mean(K.LEGITIMATE), 4).alias("coefficient"))
    return long, weights


def n1(spark, folder):
    return explain.top_features(explain.contributions(*_linear(spark, folder)))


def n2(spark, folder):
    long, weights = _linear(spark, folder)
    n = T.labelled(spark, folder).agg(F.count("*")).scalar()
    return explain.global_summary(explain.contributions(long, weights), n)


def n3(spark, folder):
    return _rounded(models.feature_importance(models.train(
        T.labelled(spark, folder), "random_forest")))


def n1_model(spark, folder):
    """Contributions under the coefficients of a fitted logistic regression."""
    trained = models.train(T.labelled(spark, folder), "logistic_regression")
    cleaned = clean_messages(T.messages(spark, folder), out="clean")
    vectors = tfidf.transform_tfidf(cleaned, trained.vocabulary, text="clean")
    values = tfidf.long_weights(vectors, ["msg_id"], trained.vocabulary).select(
        "msg_id", F.col("term").alias("feature"), F.col("weight").alias("value"))
    values = values.unionByName(explain.long_features(
        with_manual_features(cleaned, "clean"), K.MANUAL_FEATURES))
    weights = models.coefficients(trained).select("feature", "coefficient")
    return explain.top_features(explain.contributions(values, weights))


def _profile(fn):
    return lambda spark, folder: fn(T.labelled(spark, folder))


def o6(spark, folder):
    return profile.cleaning_effect(clean_steps(T.messages(spark, folder), "message", "clean"))


def p1(spark, folder):
    raw = streams.read_stream(spark, folder, "documents").select(
        F.col("doc_id").alias("msg_id"), F.col("text").alias("message"))
    scored = streams.score_stream(raw).select("msg_id", "risk_score", "risk_level")
    return streams.run_available(scored, "scored-stream")


def _turn_stream(spark, folder):
    turns = streams.read_stream(spark, folder, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("turn"), F.col("text").alias("message"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn") * 20).alias("ts"))
    return streams.score_stream(turns)


def _alerts(counts):
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return counts.select(as_text("start"), as_text("end"), "n_messages", "n_alerts", "max_score")


def p2(spark, folder):
    return _alerts(streams.latest_windows(streams.alert_counts(_turn_stream(spark, folder)), "alerts"))


def p2_events(spark, folder):
    """Alerts over the properties of events, in windows of their own time."""
    events = streams.read_stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", "props").alias("message"))
    counts = streams.alert_counts(streams.score_stream(events), length="1 hour")
    return _alerts(streams.latest_windows(counts, "event-alerts"))


def p3(spark, folder):
    return streams.run_available(streams.rolling_risk(_turn_stream(spark, folder)), "rolling")


def l5_all(spark, folder):
    """All disguised variants of fraudulent messages, whether they lower the score or not."""
    return robustness.evading(T.labelled(spark, folder), only_successful=False).select(
        "msg_id", "kind", "label", "original_score", "variant_score")


QUERIES = {
    "a1_a9_delimited_round_trip": a1_a9, "a15_state_round_trip": a15, "l5_disguised_scores": l5_all,
    "a5_label_map": a5, "a6_drop_blank": a6, "a10_json_conversations": a10,
    "a11_text_conversations": a11,
    "g1_label_ids": g1, "g2_stratified_split": g2, "g3_naive_bayes": _trained("naive_bayes"),
    "g4_h1_logistic_regression": _trained("logistic_regression"),
    "g5_linear_svc": _trained("linear_svc"), "g5_linear_svc_calibrated": _trained("linear_svc_calibrated"),
    "g6_random_forest": _trained("random_forest"), "g7_boosted_trees": _trained("boosted_trees"),
    "g8_class_weights": g8, "g10_confusion_matrix": g10, "g11_binary_metrics": g11,
    "g12_class_metrics": g12, "g13_classification_report": g13, "g14_roc_auc": g14,
    "g15_errors": g15, "g16_model_comparison": g16, "g17_feature_ablation": g17,
    "h2_h5_combined_levels": h2_h4, "i6_i7_anomaly_scores": i6, "j8_stacking": j8,
    "k18_window_model": k18, "l1_perturbations": l1, "l2_l3_stability": l2_l3,
    "l4_disguises": l4, "l5_evading_variants": l5, "m4_boosting_search": m4,
    "n1_contributions": n1, "n1_model_contributions": n1_model, "n2_global_summary": n2,
    "n3_feature_importance": n3, "o1_class_shares": _profile(profile.class_shares),
    "o2_length_summary": _profile(profile.length_summary),
    "o3_length_histogram": _profile(profile.length_histogram),
    "o4_signal_prevalence": _profile(profile.signal_prevalence),
    "o5_top_words": _profile(profile.top_words), "o6_cleaning_effect": o6,
    "p1_scored_stream": p1, "p2_windowed_alerts": p2, "p2_event_alerts": p2_events, "p3_rolling_risk": p3,
}
