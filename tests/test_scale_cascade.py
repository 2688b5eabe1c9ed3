"""The cascade reads and cleans every text once, and counts pairs of words only where both are frequent."""

from pyspark.sql import functions as F

from riskloom.functions.rules import score_messages
from riskloom.operators import augment, bayes, tfidf
from riskloom.plans import scoring_queries as Q
from test_scale_vocabulary import _plain

TEXTS = [
    (1, "URGENT verify your password now"), (2, "see you at lunch"), (3, None), (4, ""), (5, "¡¿ ()"), (6, "see you at lunch"),
    (7, "your bank account 500 pesos www.a.com/b"), (8, "no longer urgent"), (8, "password again"), (None, "see you"),
]
LABELS = [(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0), (6, 1), (7, 1), (8, 0), (None, 1), (99, 1)]


def _folder(spark, tmp_path):
    spark.createDataFrame([(*r, "en", "src1") for r in TEXTS], "doc_id bigint, text string, lang string, source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, t) for i, t in LABELS], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_cascade_texts_are_dealt_once(spark, monkeypatch, tmp_path):
    folder, dealt, deal = _folder(spark, tmp_path), [], Q.T.dealt
    monkeypatch.setattr(Q.T, "dealt", lambda df: dealt.append(1) or deal(df))
    Q.local_scores(spark, folder)
    assert len(dealt) == 1


def test_cascade_texts_give_what_the_messages_give(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    texts, messages, labelled = Q.message_texts(spark, folder), Q.T.messages(spark, folder), Q.T.labelled(spark, folder)
    assert texts.count() == len(TEXTS)
    cases = Q.labelled_texts(texts).filter("has_content").select("msg_id", "label", "clean")
    assert _rows(cases) == _rows(Q.cleaned_cases(spark, folder))
    model, plain = bayes.fit_cleaned(Q.labelled_texts(texts).filter("text is not null")), bayes.fit_evidence(labelled)
    assert _rows(model) == _rows(plain)
    rules = ["msg_id", "risk_score", "risk_level"]
    assert _rows(texts.select(*rules)) == _rows(score_messages(messages).select(*rules))
    scores = ["msg_id", "bayes_score"]
    assert _rows(bayes.score_cleaned(texts, model, "text").select(*scores)) == _rows(bayes.score_messages(messages, plain).select(*scores))


def test_pseudo_labels_need_no_text(spark):
    rows = spark.createDataFrame([(1, 0.95, "fraudulent", 7), (2, 0.5, "fraudulent", 8)], "msg_id long, confidence double, predicted_class string, n_chars int")
    assert [tuple(r) for r in augment.pseudo_labels(rows, carry=["n_chars"]).collect()] == [(1, 7, "fraudulent", "pseudo_label")]


def test_pairs_are_counted_only_for_frequent_words(spark, monkeypatch):
    texts = ["aa bb"] * 9 + ["aa cc bb"] + [f"w{i} v{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, message string")
    for ngrams in ((1, 2), (1, 3)):
        counted, totals = [], tfidf._totals
        with monkeypatch.context() as m:
            m.setattr(tfidf, "_totals", lambda rows, n, counted=counted, totals=totals: counted.append(rows) or totals(rows, n))
            found = tfidf.fit_tfidf(df, max_features=2, ngrams=ngrams, min_df=1)
            assert {(r["term"], r["df"], r["tf"]) for r in found.collect()} == _plain(texts, ngrams, 2, 1)
        assert counted[0].count() == 20 and counted[0].filter(F.col("_w2").isNotNull()).count() == 9
