"""Queries over TF-IDF, evidence, cases, vectors and the gated cascade."""

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.rules import score_messages
from riskloom.functions.text import clean_messages, clean_steps, has_content
from riskloom.operators import anomaly, augment, bayes, cascade, metrics, nearest, sweep, tfidf
from riskloom.operators.models import combine_with_rules
from riskloom.plans import tables as T
from riskloom.session import staged


def cleaned(spark, folder):
    return clean_messages(T.messages(spark, folder), out="clean").select("msg_id", "clean")


def cleaned_cases(spark, folder):
    return clean_messages(T.labelled(spark, folder), out="clean").select("msg_id", "label", "clean")


def f1(spark, folder):
    counts = tfidf.term_counts(T.messages(spark, folder), ["msg_id"], "message")
    return counts.groupBy("msg_id").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_grams"), F.max("tf").alias("max_tf"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def _vocabulary(vocabulary):
    return vocabulary.select(
        "term", "term_id", "df", F.col("tf").cast("bigint").alias("tf"), F.round("idf", 6).alias("idf"))


def f2(spark, folder):
    rows = staged(cleaned(spark, folder), "cleaned", "zstd")
    return _vocabulary(tfidf.fit_tfidf(rows, text="clean"))


def f3(spark, folder):
    rows = staged(cleaned(spark, folder), "cleaned")
    vocabulary = staged(tfidf.fit_tfidf(rows, text="clean"), "vocabulary")
    vectors = tfidf.transform_tfidf(rows, vocabulary, text="clean")
    return tfidf.long_weights(vectors, ["msg_id"], vocabulary).select(
        "msg_id", "term", F.round("weight", 6).alias("weight"))


def f5(spark, folder):
    legit = cleaned_cases(spark, folder).filter(F.col("label") == K.LEGITIMATE)
    return _vocabulary(tfidf.fit_tfidf(
        legit, text="clean", max_features=K.ANOMALY_MAX_FEATURES, ngrams=K.ANOMALY_NGRAMS))


def i2(spark, folder):
    table = bayes.evidence_table(bayes.fit_evidence(T.labelled(spark, folder)))
    return table.select("feature", F.round("p_fraud", 6).alias("p_fraud"),
                        F.round("p_legit", 6).alias("p_legit"))


def i3(spark, folder):
    model = bayes.fit_evidence(T.labelled(spark, folder))
    return bayes.score_messages(T.messages(spark, folder), model).select("msg_id", "bayes_score")


def i5(spark, folder):
    rows = T.labelled(spark, folder)
    scored = bayes.score_messages(rows, bayes.fit_evidence(rows))
    return metrics.roc_auc(scored, F.col("label") == K.FRAUDULENT, "bayes_score").select(
        "n_positive", "n_negative", F.round("auc", 6).alias("auc"))


def message_texts(spark, folder):
    """Every message, cleaned and scored by the rules in one reading of its text, written once.

    ``text`` is what the scorers read: the cleaned text, or the raw one where cleaning leaves nothing.
    """
    rows = score_messages(clean_steps(T.messages_with_labels(spark, folder), "message", "clean"))
    blank = F.col("clean") == ""
    return staged(rows.select(
        "msg_id", "labels", "risk_score", "risk_level", blank.alias("is_blank"),
        has_content(F.col("message")).alias("has_content"),
        F.when(blank, F.col("message")).otherwise(F.col("clean")).alias("text")), "texts", "zstd")


def labelled_texts(texts):
    """Rows of ``message_texts`` that have a label, once for each label."""
    return texts.select("msg_id", F.explode("labels").alias("label"), "has_content", "text",
                        F.when(F.col("is_blank"), "").otherwise(F.col("text")).alias("clean"))


def case_scores(texts):
    """Neighbour share of every message against the labelled messages."""
    labelled = labelled_texts(texts).filter("has_content").select("msg_id", "label", "clean")
    vocabulary = staged(tfidf.fit_tfidf(labelled, text="clean"), "vocabulary")
    cases = nearest.build_cases(tfidf.transform_tfidf(labelled, vocabulary, text="clean", carry=["label"], unit=False))
    # Vectors are written once, in blocks, by the search.
    return nearest.query_cases(tfidf.transform_tfidf(texts, vocabulary, text="text", unit=False), cases)


def i8(spark, folder):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return case_scores(message_texts(spark, folder)).select(
        "msg_id", "cbr_score", join("top_k_labels").alias("top_k_labels"),
        F.round(F.aggregate("similarities", F.lit(0.0), lambda a, x: a + x), 4).alias("similarity_sum"),
        "most_similar")


def i9(spark, folder):
    rows = T.labelled(spark, folder).filter(F.col("label").isin(K.BINARY_LABELS))
    fraud = (F.col("label") == K.FRAUDULENT).cast("bigint")
    return rows.agg(F.count("*").alias("n_cases"), F.sum(fraud).alias("n_fraud"),
                    F.sum(1 - fraud).alias("n_legit"))


def i10(spark, folder):
    return nearest.reference_sample(T.vectors(spark, folder)).select("vec_id", "label")


def vector_scores(spark, folder):
    vectors = T.vectors(spark, folder)
    return nearest.search_vectors(vectors, nearest.reference_sample(vectors))


def searcher(spark, folder):
    """Vector search for the messages that it is given, and no others."""
    vectors = T.vectors(spark, folder)

    def search(rows):
        wanted = vectors.join(rows.select(F.col("msg_id").alias("vec_id")), "vec_id", "left_semi")
        return nearest.search_vectors(wanted, nearest.reference_sample(vectors)).withColumnRenamed("vec_id", "msg_id")
    return search


def i11(spark, folder):
    return vector_scores(spark, folder).select(
        "vec_id", "fraud_similarity", "legit_similarity",
        F.array_join(F.transform("top_neighbors", lambda n: F.concat_ws(
            ":", n["vec_id"].cast("string"), n["label"].cast("string"))), ",").alias("neighbors"))


def local_scores(spark, folder):
    """What every message is scored by; the case share stands in for the classifier."""
    texts = message_texts(spark, folder)
    evidence = bayes.fit_cleaned(labelled_texts(texts).filter("text is not null"))
    # The levels ask only whether a text is blank: no text goes through the join.
    rows = bayes.score_cleaned(texts, evidence, "text").select(
        "msg_id", F.when(F.col("is_blank"), "").otherwise(".").alias("clean"),
        "risk_score", "risk_level", "bayes_score")
    both = rows.join(case_scores(texts).select("msg_id", "cbr_score"), "msg_id")
    both = both.withColumns({
        "predicted_class": F.when(F.col("cbr_score") >= 0.5, K.FRAUDULENT).otherwise(K.LEGITIMATE),
        "confidence": F.greatest("cbr_score", 1 - F.col("cbr_score"))})
    return staged(combine_with_rules(both).drop("clean", "recommendation", "risk_level"), "cascade")


def cascade_inputs(spark, folder):
    """Every scorer's output of every message, also where a gate would close it."""
    search = vector_scores(spark, folder).select(
        F.col("vec_id").alias("msg_id"), "fraud_similarity", "legit_similarity")
    return staged(local_scores(spark, folder).join(search, "msg_id", "left"), "cascade")


def _hashed(factor):
    return F.pmod(F.pmod(F.col("msg_id"), F.lit(1000)) * factor, F.lit(1000)) / 1000.0


def outside_transformer():
    """Stand-in for a transformer of three messages in four."""
    return F.when(F.col("msg_id") % 4 != 3, _hashed(389))


def with_outside_scores(df):
    """Stand-ins for an anomaly detector and a transformer."""
    return df.withColumns({"anomaly_score": _hashed(617), "transformer_proba": outside_transformer()})


def routed(spark, folder, judge=None, meta=None, overrides=None):
    rows = staged(with_outside_scores(local_scores(spark, folder)), "routed")
    return cascade.route(rows, searcher(spark, folder), judge, meta, overrides=overrides)


def with_meta(df):
    """A fixed blend stands in for the stacking model."""
    return df.withColumn("meta_proba", F.round(
        0.5 * F.col("cbr_score") + 0.3 * F.col("risk_score") / 100.0 + 0.2 * F.col("bayes_score"), 4))


def verdict_table(df):
    """Stand-in for verdicts of an outside reviewer on every third message."""
    types = F.array(*[F.lit(t) for t in [*K.FRAUD_TYPE_SUFFIX, "none"]])
    return df.filter(F.col("msg_id") % 3 == 0).select(
        "msg_id", F.when(F.col("msg_id") % 2 == 0, K.FRAUDULENT).when(
            F.col("msg_id") % 5 == 0, K.SUSPICIOUS).otherwise(K.LEGITIMATE).alias("verdict"),
        ((50 + F.col("msg_id") % 50) / 100.0).alias("verdict_confidence"),
        F.get(types, (F.col("msg_id") % 8).cast("int")).alias("fraud_type"))


def _flags(df):
    return df.select("msg_id", *[F.col(c).cast("int").alias(c) for c in ("gate1", "gate2", "is_open")])


def _decision(df):
    return df.select(
        "msg_id", "predicted_class", F.round("confidence", 4).alias("confidence"), "risk_level",
        "recommendation", F.array_join("layers_used", ",").alias("layers_used"))


RELAXED = {"ml_conf_certain": 0.80, "rule_fraud_min": 20, "rule_legit_max": 40,
           "emb_fraud_confirm": 0.30, "emb_legit_confirm": 0.30, "emb_boost_high": 0.45,
           "emb_boost_medium": 0.35, "cbr_high_thr": 0.50, "meta_med_thr": 0.20}


def j1_j2(spark, folder):
    return _flags(cascade.with_gates(cascade_inputs(spark, folder)))


def j3(spark, folder):
    return _decision(routed(spark, folder))


def j4_j6(spark, folder):
    return _decision(routed(spark, folder, verdict_table))


def j7(spark, folder):
    rows = cascade.meta_features(cascade.with_gates(with_outside_scores(cascade_inputs(spark, folder))))
    return rows.select("msg_id", *[
        F.round(f"m_{n}", 4).alias(n) for n in K.META_FEATURES])


def j9(spark, folder):
    return _decision(routed(spark, folder, verdict_table, with_meta))


def j10(spark, folder):
    return _decision(routed(spark, folder, meta=with_meta, overrides=RELAXED))


def j11(spark, folder):
    return routed(spark, folder, meta=with_meta).groupBy("predicted_class", "risk_level").agg(
        F.count("*").alias("n"), F.round(F.avg("risk_score"), 4).alias("mean_score"),
        F.sum(F.col("is_open").cast("bigint")).alias("n_open"))


def anomaly_scores(spark, folder):
    """Forest scores of every message; the forest learns from legitimate messages."""
    rows = staged(clean_steps(T.messages(spark, folder), "message", "clean").select(
        "msg_id", "clean", (F.col("clean") == "").alias("is_blank")), "cleaned")
    legit = T.labels(spark, folder).filter(F.col("label") == K.LEGITIMATE).select("msg_id")
    train = rows.join(legit, "msg_id")
    vocabulary = staged(tfidf.fit_tfidf(
        train, text="clean", max_features=K.ANOMALY_MAX_FEATURES, ngrams=K.ANOMALY_NGRAMS), "vocabulary")
    vectors = staged(tfidf.transform_tfidf(
        rows, vocabulary, text="clean", ngrams=K.ANOMALY_NGRAMS, carry=["is_blank"]), "vectors")
    known = vectors.join(legit, "msg_id")
    return anomaly.score_forest(vectors, anomaly.fit_forest(known), known)


def _sweep_rows(spark, folder, scores):
    """Every scorer's output of every labelled message, with fitted forest scores."""
    rows = with_meta(cascade_inputs(spark, folder)).join(scores, "msg_id", "left")
    return rows.join(T.labels(spark, folder), "msg_id")


def _sweep(spark, folder):
    """Over forest scores; no transformer is built, so its probability stays unknown."""
    scores = anomaly_scores(spark, folder).select("msg_id", "anomaly_score")
    return sweep.sweep_thresholds(_sweep_rows(spark, folder, scores).withColumn(
        "transformer_proba", F.lit(None).cast("double")))


def _outside_sweep(spark, folder):
    """Over forest scores and a stand-in transformer, so that every threshold meets rows that it can touch.

    One score an id, the highest, so that repeated ids add no rows."""
    scores = anomaly_scores(spark, folder).groupBy("msg_id").agg(F.max("anomaly_score").alias("anomaly_score"))
    return sweep.sweep_thresholds(_sweep_rows(spark, folder, scores).withColumn(
        "transformer_proba", outside_transformer()))


def m1_forest(spark, folder):
    return _sweep(spark, folder).select("grid_id", *K.SWEEP_BOUNDS, "tp", "fp", "fn", "f1_score")


def m1(spark, folder):
    return _outside_sweep(spark, folder).select("grid_id", *K.SWEEP_BOUNDS, "tp", "fp", "fn", "f1_score")


def m2(spark, folder):
    return sweep.best_so_far(_outside_sweep(spark, folder))


def m3_m5(spark, folder):
    return sweep.best_thresholds(_outside_sweep(spark, folder))


def _fraud_weights(spark, folder):
    labelled = staged(cleaned_cases(spark, folder), "cases")
    vocabulary = staged(tfidf.fit_tfidf(labelled, text="clean"), "vocabulary")
    fraud = labelled.filter(F.col("label") == K.FRAUDULENT)
    vectors = tfidf.transform_tfidf(fraud, vocabulary, text="clean")
    return augment.class_term_weights(
        tfidf.long_weights(vectors, ["msg_id"], vocabulary), fraud.agg(F.count("*")).scalar())


def l6(spark, folder):
    return _fraud_weights(spark, folder).select("term", F.round("weight", 6).alias("weight"))


def l7(spark, folder):
    return augment.top_terms(_fraud_weights(spark, folder))


def _unlabelled(spark, folder):
    """Cascade inputs of the messages without a label."""
    return cascade_inputs(spark, folder).join(T.labels(spark, folder), "msg_id", "left_anti")


def l8(spark, folder):
    rows = _unlabelled(spark, folder).join(T.lengths(spark, folder), "msg_id")
    return augment.pseudo_labels(rows, carry=["n_chars"]).select("msg_id", "label", "source", "n_chars")


def l9(spark, folder):
    original = T.labelled(spark, folder).select("msg_id", "message", "label")
    rows = _unlabelled(spark, folder).join(T.messages(spark, folder).select("msg_id", "message"), "msg_id")
    return augment.augment(original, augment.pseudo_labels(rows)).select("msg_id", "label", "source", "shuffle_key")


def l10(spark, folder):
    return augment.rebalance(T.labelled(spark, folder).select("msg_id", "label")).select(
        "msg_id", "label", "copy")


QUERIES = {
    "f1_term_counts": f1,
    "f2_vocabulary": f2,
    "f3_tfidf_weights": f3,
    "f5_legitimate_vocabulary": f5,
    "i2_evidence_table": i2,
    "i3_i4_bayes_scores": i3,
    "i5_bayes_auc": i5,
    "i8_nearest_cases": i8,
    "i9_case_base": i9,
    "i10_reference_sample": i10,
    "i11_vector_search": i11,
    "j1_j2_gates": j1_j2,
    "j3_boosts": j3,
    "j4_j6_verdicts": j4_j6,
    "j7_meta_features": j7,
    "j9_meta_override": j9,
    "j10_threshold_overrides": j10,
    "j11_cascade": j11,
    "l6_fraud_term_weights": l6,
    "l7_top_fraud_terms": l7,
    "l8_pseudo_labels": l8,
    "l9_augmented_table": l9,
    "l10_rebalanced_table": l10,
    "m1_threshold_sweep": m1,
    "m1_forest_sweep": m1_forest,
    "m2_best_so_far": m2,
    "m3_m5_best_thresholds": m3_m5,
}
