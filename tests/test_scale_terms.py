"""Terms are counted over batches of texts by the numbers of their words, without building any n-gram."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import term_counter, tfidf

TEXTS = ["", "a", "red sky red sky at night", "sky red", "at night at night at", "unknown words here", "night sky", "at night sky red sky at"]


@pytest.mark.parametrize("ngrams", [(1, 3), (1, 2), (2, 3), (1, 1)])
def test_terms_are_counted_as_by_listing_all_runs(monkeypatch, ngrams):
    monkeypatch.setattr(term_counter, "WORDS", 5)
    terms = ["red", "sky", "at", "red sky", "sky red", "at night at", "night at night", "sky at night", "night sky"]
    lists = pa.array([t.split() for t in TEXTS], pa.list_(pa.string()))
    out = term_counter.Terms(terms).counted(lists, *ngrams).to_pylist()
    for text, row in zip(TEXTS, out, strict=True):
        w = text.split()
        runs = Counter(" ".join(w[i:i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1))
        wanted = sorted((terms.index(t), float(c)) for t, c in runs.items() if t in terms)
        assert list(zip(row["ids"], row["counts"], strict=True)) == wanted


def test_vectors_build_no_run_of_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "msg_id long, message string")
    vocabulary = tfidf.fit_tfidf(df, max_features=50, min_df=1)
    vectors = tfidf.transform_tfidf(df, vocabulary)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "concat_ws" not in plan and "Exchange" not in plan
    found = {r.msg_id: r.vector for r in vectors.collect()}
    assert found[0] == [] and found[99] == [] and found[1] == []
    assert all(abs(sum(x.weight ** 2 for x in v) - 1) < 1e-9 for v in found.values() if v)
    assert len(found[2]) == 12 and [x.term_id for x in found[2]] == sorted(x.term_id for x in found[2])


def test_folding_leaves_ascii_to_one_look(spark):
    df = spark.createDataFrame([("Plain ASCII",), ("Ünïcode Kelvin é é",), ("ﬀ ＡＢ",), (None,)], "t string")
    source, target = tfidf._accent_table()
    old = F.translate(F.regexp_replace(F.lower("t"), r"\p{Mn}+", ""), source, target)
    assert all(r[0] == r[1] for r in df.select(tfidf.fold(F.col("t")), old).collect())
    assert K.TERM and df.select(tfidf.fold(F.col("t"))).first()[0] == "plain ascii"
