"""Vocabulary counts that leave out rare long terms, with the same results."""

import re
from collections import Counter

import pytest

from riskloom.operators import tfidf

TEXTS = [
    "red blue green red blue green red", "blue green red blue", "Réd blue green, red blue", "one two three four five",
    "one two three", "solo", "", None, "x y z", "two three red blue green", "red red red red", "green green",
]


def _plain(texts, ngrams, max_features, min_df):
    tf, df = Counter(), Counter()
    for t in texts:
        words = re.findall(r"\w{2,}", (t or "").lower().replace("é", "e"))
        grams = [" ".join(words[i:i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    kept = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    return {(t, df[t], tf[t]) for t in kept}


def _messages(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "msg_id bigint, message string").repartition(3)


@pytest.mark.parametrize("ngrams,max_features,min_df", [
    ((1, 2), 9, 1), ((1, 3), 5, 2), ((1, 3), 9, 1), ((1, 3), 500, 2), ((2, 3), 2, 1), ((3, 3), 5, 1), ((1, 4), 9, 1)])
def test_vocabulary_is_exact(spark, ngrams, max_features, min_df):
    found = tfidf.fit_tfidf(_messages(spark), max_features=max_features, ngrams=ngrams, min_df=min_df)
    assert {(r["term"], r["df"], r["tf"]) for r in found.collect()} == _plain(TEXTS, ngrams, max_features, min_df)


@pytest.mark.parametrize("ties", [False, True])
def test_longest_terms_are_counted_only_for_frequent_parts(spark, monkeypatch, ties):
    """Where ties leave too many parts, all terms are counted instead."""
    texts = ["aa bb cc"] * (1 if ties else 9) + [f"w{i} v{i} u{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, message string")
    counted, totals = [], tfidf._totals
    monkeypatch.setattr(tfidf, "_totals", lambda rows, ngrams: counted.append((ngrams, rows)) or totals(rows, ngrams))
    found = tfidf.fit_tfidf(df, max_features=4, min_df=1)
    assert {(r["term"], r["df"], r["tf"]) for r in found.collect()} == _plain(texts, (1, 3), 4, 1)
    assert [ngrams for ngrams, _ in counted] == [(1, 2), (1, 3) if ties else (3, 3)]
    if not ties:
        assert counted[-1][1].count() == 9
