"""TF-IDF over word n-grams in DataFrame operations."""

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.text import let
from riskloom.operators import term_counter
from riskloom.session import staged


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose compatibility form is one base character plus marks."""
    source, target = [], []
    for code in [*range(0xA0, 0x3000), *range(0xFF00, 0xFFF0)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code))
                if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents; ASCII has none."""
    source, target = _accent_table()
    plain = lambda low: F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), source, target)
    return let(F.lower(text), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(plain(low)))


def _term_runs(df: DataFrame, columns: list, text: str, ngrams: tuple[int, int]) -> DataFrame:
    """``(*columns, _grams, _starts)``: sorted n-grams and where each term starts.

    Terms of one message are counted inside its row (sorted array, run lengths),
    so that no shuffle by (message, term) is needed.
    """
    names = [c if isinstance(c, str) else "_carry" for c in columns]
    words = df.select(*columns, F.regexp_extract_all(
        fold(F.coalesce(F.col(text), F.lit(""))), F.lit(K.TERM), F.lit(0)).alias("_words"))
    grams = words.select(*names, F.sort_array(_grams("_words", ngrams)).alias("_grams"))
    count = F.size("_grams")
    return grams.select(*names, "_grams", F.when(count > 0, F.filter(
        F.sequence(F.lit(1), count),
        lambda i: (i == 1) | (F.element_at("_grams", i) != F.element_at(
            "_grams", F.greatest(i - 1, F.lit(1)))),
    )).alias("_starts"))


def _run(start: Column, j: Column) -> list[Column]:
    return [F.element_at("_grams", start).alias("term"),
            (F.coalesce(F.get("_starts", j + 1), F.size("_grams") + 1) - start).alias("tf")]


def term_counts(
    df: DataFrame, key: list[str], text: str, ngrams: tuple[int, int] = K.TFIDF_NGRAMS,
) -> DataFrame:
    """Long table ``(*key, term, tf)``."""
    runs = F.transform(F.col("_starts"), lambda s, j: F.struct(*_run(s, j)))
    return _term_runs(df, key, text, ngrams).select(
        *key, F.explode(runs).alias("_r")).select(*key, "_r.term", "_r.tf")


def _word_rows(df: DataFrame, text: str, most: int) -> DataFrame:
    """``(_w1 .. _wn, _new1 .. _newn)``: every word with those after it, sorted within its message.

    Rows of a message that begin with the same words follow each other, so that ``_newk`` is 1
    once for every different run of ``k`` words. Past the end of a message words are null.
    """
    words = df.select(F.regexp_extract_all(
        fold(F.coalesce(F.col(text), F.lit(""))), F.lit(K.TERM), F.lit(0)).alias("_w1"))
    names = [f"_w{k}" for k in range(1, most + 1)]
    shifted = [F.slice("_w1", F.lit(k), F.greatest(F.size("_w1"), F.lit(1))).alias(names[k - 1]) for k in range(2, most + 1)]
    runs = words.select("_w1", *shifted).select(F.sort_array(F.arrays_zip(*names)).alias("_runs"))
    none = F.lit(None).cast(runs.schema["_runs"].dataType.elementType)
    # An outer generator infers no filter, which would sort every message twice.
    rows = runs.select("_runs", F.concat(F.array(none), "_runs").alias("_before")).select(
        F.inline_outer(F.arrays_zip("_runs", "_before")).alias("_run", "_before")).filter("_run._w1 is not null")
    same, flags = F.lit(True), []
    for name in names:
        same = same & F.col("_run")[name].eqNullSafe(F.col("_before")[name])
        flags.append(F.when(same, 0).otherwise(1).alias(f"_new{name[2:]}"))
    return rows.select(*[F.col("_run")[name].alias(name) for name in names], *flags)


def _joined(first: int, last: int) -> Column:
    """The words between two places as one term, null past the end of the message."""
    parts = [x for k in range(first, last + 1) for x in (F.lit(" "), F.col(f"_w{k}"))]
    return F.concat(*parts[1:])


def _totals(rows: DataFrame, ngrams: tuple[int, int]) -> DataFrame:
    """``(term, df, tf)`` over all messages; counts combine on the map side."""
    terms = [F.struct(_joined(1, n).alias("term"), F.col(f"_new{n}").alias("_new")) for n in range(ngrams[0], ngrams[1] + 1)]
    return rows.select(F.inline_outer(F.array(*terms))).filter("term is not null").groupBy("term").agg(
        F.sum("_new").alias("df"), F.count("*").alias("tf"))


def _most_frequent(totals: DataFrame, max_features: int, min_df: int) -> DataFrame:
    return totals.filter(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)


def _least_count(counts: DataFrame, max_features: int, bound: int) -> int | None:
    """Count that a feature must reach, given at most ``bound`` most frequent terms; None where ties leave too many."""
    found = sorted((r["tf"] for r in counts.select("tf").collect()), reverse=True)
    cut = found[max_features - 1] if len(found) >= max_features else 0
    return None if len(found) == bound and found[-1] >= cut else cut


def _of_frequent_words(rows: DataFrame, df: DataFrame, text: str, most: int, max_features: int, min_df: int) -> DataFrame:
    """Rows of ``_word_rows`` without words too rare for a feature: words alone set a least count.

    A rare first word takes its row away, another one ends the row's terms before it.
    """
    bound = K.PARTS_PER_FEATURE * max_features
    counts = _word_rows(df, text, 1).groupBy(F.col("_w1").alias("term")).agg(
        F.sum("_new1").alias("df"), F.count("*").alias("tf"))
    words = staged(_most_frequent(counts, bound, min_df), "words")
    cut = _least_count(words, max_features, bound)
    if not cut:
        return rows
    known = words.filter(F.col("tf") >= cut)
    rows = rows.join(F.broadcast(known.select(F.col("term").alias("_k1"))), F.col("_w1") == F.col("_k1"), "left_semi")
    for k in range(2, most + 1):
        rows = rows.join(F.broadcast(known.select(F.col("term").alias(f"_k{k}"))), F.col(f"_w{k}") == F.col(f"_k{k}"), "left") \
            .withColumn(f"_w{k}", F.col(f"_k{k}")).drop(f"_k{k}")
    return rows


def _frequent_terms(df: DataFrame, text: str, max_features: int, ngrams: tuple[int, int], min_df: int) -> DataFrame:
    """``(term, df, tf)`` of the most frequent terms.

    Terms of several words are counted only where their words are frequent enough, and the
    longest, nearly all of them rare, where both of their parts, one word shorter, are: a term
    is no more frequent than its parts, and the shorter terms alone already set a least count.
    Exact; where ties leave the parts too many, all terms are counted at once.
    """
    least, most = ngrams
    rows = _word_rows(df, text, most)
    if most < 3 or least == most:
        if least == 1 < most:
            rows = _of_frequent_words(rows, df, text, most, max_features, min_df)
        return _most_frequent(_totals(rows, ngrams), max_features, min_df)
    shorter, bound = (least, most - 1), K.PARTS_PER_FEATURE * max_features
    short = _word_rows(df, text, most - 1)
    if least == 1:
        short = _of_frequent_words(short, df, text, most - 1, max_features, min_df)
    parts = staged(_most_frequent(_totals(short, shorter), bound, min_df), "parts")
    cut = _least_count(parts, max_features, bound)
    if cut is None:
        return _most_frequent(_totals(rows, ngrams), max_features, min_df)
    known = parts.filter(F.col("tf") >= cut).select(F.col("term").alias("_part"))
    for first in (1, 2):
        rows = rows.join(F.broadcast(known), _joined(first, first + most - 2) == F.col("_part"), "left_semi")
    both = parts.unionByName(_totals(rows, (most, most)))
    return _most_frequent(both, max_features, min_df)


def fit_tfidf(
    df: DataFrame, key: str = "msg_id", text: str = "message",
    max_features: int = K.TFIDF_MAX_FEATURES, ngrams: tuple[int, int] = K.TFIDF_NGRAMS,
    min_df: int = K.TFIDF_MIN_DF,
) -> DataFrame:
    """``(term, term_id, df, tf, idf)`` of the most frequent terms, at most ``max_features``.

    ``df`` should be a written table: it is read once for words, once for pairs and once for longer terms.
    """
    total = df.agg(F.count("*")).scalar()
    kept = _frequent_terms(df, text, max_features, ngrams, min_df)
    # At most max_features rows: one partition is enough to number them.
    return kept.select(
        "term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"), "df", "tf",
        (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))


def _grams(words: str, ngrams: tuple[int, int]) -> Column:
    """All n-grams of a word array, in the order of the text.

    The lambdas see their own arguments only: a word array named inside one would be
    computed again for every word wherever the optimizer inlines its column.
    """
    parts = []
    for n in range(ngrams[0], ngrams[1] + 1):
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, F.lit(1), count)
        for k in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(words, F.lit(k), count), lambda a, b: F.concat_ws(" ", a, b))
        parts.append(grams)
    return F.concat(*parts)


def transform_tfidf(
    df: DataFrame, vocabulary: DataFrame, key: str = "msg_id", text: str = "message",
    ngrams: tuple[int, int] = K.TFIDF_NGRAMS, carry: list[str] | None = None, unit: bool = True,
) -> DataFrame:
    """``(key, *carry, vector)``: unit-length array of ``(term_id, weight)``, sorted.

    With ``unit=False`` the weights are not yet divided by the length, the column ``norm``:
    before that a term has only as many weights as counts, so that they are small to store.

    A narrow step without any shuffle: the terms, at most ``max_features``, are
    collected once; terms are counted over batches of texts by the numbers of their words,
    weights and norm are computed inside the row, the idf being a literal. Messages without a
    known term keep an empty vector.
    """
    carry = carry or []
    kind = "array<struct<term_id:int,weight:double>>"
    terms = vocabulary.select("term", "term_id", "idf").orderBy("term_id").collect()
    if not terms:
        none = df.select(key, *carry, F.array().cast(kind).alias("vector"))
        return none if unit else none.withColumn("norm", F.lit(0.0))
    known, (least, most) = term_counter.Terms([r["term"] for r in terms]), ngrams

    @F.arrow_udf("struct<ids: array<int>, counts: array<double>>")
    def count(words: pa.Array) -> pa.Array:
        return known.counted(words, least, most)

    idf = F.lit(np.array([r["idf"] for r in terms]))
    counted = df.select(key, *carry, F.regexp_extract_all(
        fold(F.coalesce(F.col(text), F.lit(""))), F.lit(K.TERM), F.lit(0)).alias("_words")).select(key, *carry, count("_words").alias("_tf"))
    weights = F.zip_with("_tf.counts", "_tf.ids", lambda tf, at: (1 + F.log(tf)) * F.get(idf, at))
    weighted = counted.select(key, *carry, F.col("_tf.ids").alias("_ids"), weights.alias("_ws"))
    norm = F.sqrt(F.aggregate("_ws", F.lit(0.0), lambda a, x: a + x * x))
    vector = lambda ws: F.zip_with("_ids", ws, lambda i, w: F.struct(
        i.alias("term_id"), w.alias("weight"))).alias("vector")
    if not unit:
        return weighted.select(key, *carry, vector("_ws"), norm.alias("norm"))
    # As an argument the norm is computed once per row; inside the lambda it
    # would be computed again for every element.
    return weighted.select(key, *carry, vector(
        F.zip_with("_ws", F.array_repeat(norm, F.size("_ws")), lambda x, n: x / n)))


def long_weights(vectors: DataFrame, key: list[str], vocabulary: DataFrame) -> DataFrame:
    """``(*key, term, weight)`` from vectors."""
    # An outer explode infers no filter, which would compute every vector twice.
    flat = vectors.select(*key, F.explode_outer("vector").alias("_v")).select(
        *key, "_v.term_id", "_v.weight").filter("term_id IS NOT NULL")
    return flat.join(F.broadcast(vocabulary.select("term_id", "term")), "term_id").drop("term_id")
