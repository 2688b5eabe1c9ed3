"""Cleaning, rules, entities and features on small literal tables."""

import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import entities, features, rules, text

CLEANING = {
    "": "", "   ": "", "Hello World": "hello world",
    "visit http://x.com/a now": "visit <url> now",
    "see www.site.org today": "see <url> today",
    "go bit.ly/abc": "go <url>",
    "promo shop.io/deal!": "promo <url>",
    "mail me a@b.com": "mail me <email>",
    "call 5512345678": "call <phone>",
    "code 1234": "code 1234",
    "pay $5,000 now": "pay <money> now",
    "son 10,000 pesos": "son <money>",
    "a b c": "a b c",
    "¿Cómo estás?": "cómo estás?",
}


def test_cleaning_examples(spark):
    rows = spark.createDataFrame([(k,) for k in CLEANING], "message string")
    got = text.clean_steps(rows, "message", "clean").collect()
    assert {r.message: r.clean for r in got} == CLEANING


def test_null_is_cleaned_to_empty(spark):
    df = spark.createDataFrame([(None,)], "message string")
    assert text.clean_steps(df, "message", "clean").first().clean == ""


def test_clean_table_drops_blank_rows(spark):
    df = spark.createDataFrame([("a b", "x"), ("  ", "y"), ("c", "z"), ("¿¡", "w")], "message string, label string")
    assert text.clean_messages(df).count() == 2


def score(spark, message):
    df = spark.createDataFrame([(message,)], "message string")
    return rules.score_messages(df).first()


@pytest.mark.parametrize("message", ["", "   ", None])
def test_blank_has_no_risk(spark, message):
    row = score(spark, message)
    assert (row.risk_score, row.risk_level, row.signals) == (0, "low", [])


@pytest.mark.parametrize("message,signal", [
    ("mira http://a.mx y www.b.mx", "Contiene URLs (2)"),
    ("llama al 55 1234 5678", K.SIGNAL_TEXT["phone"]),
    ("escribe a x@y.org", K.SIGNAL_TEXT["email"]),
    ("debes 500 pesos", K.SIGNAL_TEXT["money"]),
    ("URGENTE", K.SIGNAL_TEXT["urgency"]),
    ("servicio desactivado", K.SIGNAL_TEXT["block"]),
    ("gran sorteo", K.SIGNAL_TEXT["prize"]),
    ("el giro postal", K.SIGNAL_TEXT["transfer"]),
    ("dame tu nip", K.SIGNAL_TEXT["credential"]),
    ("hay multa", K.SIGNAL_TEXT["pressure"]),
    ("mi tarjeta", K.SIGNAL_TEXT["money_words"]),
    ("eh!!!", K.SIGNAL_TEXT["exclamation"]),
])
def test_every_signal(spark, message, signal):
    assert signal in score(spark, message).signals


def test_money_words_only_without_amount(spark):
    assert K.SIGNAL_TEXT["money_words"] not in score(spark, "mi tarjeta tiene $500").signals


def test_loaded_message_is_high_and_capped(spark):
    row = score(spark, "URGENTE: su cuenta fue bloqueada, verifique su contraseña en http://a.com/x "
                       "o pague $500, ganó un premio, multa, llame 5512345678 a@b.com transferencia!!!")
    assert row.risk_level == "high" and row.risk_score == 100 and len(row.signals) >= 3


def test_long_runs_stay_fast(spark):
    big = "1,1," * 20_000 + " " + "a" * 80_000 + " " + "." * 80_000
    assert score(spark, big).risk_score == 0
    df = spark.createDataFrame([(big,)], "message string")
    assert len(text.clean_steps(df, "message", "c").first().c) > 100_000


def test_entities(spark):
    df = spark.createDataFrame([
        (1, "llama +52 55 1234 5678"), (2, "El evento es en 2025"), (3, "código 1234"),
        (4, "BBVA: paga $5,000 pesos en www.x.mx"), (5, "cuenta 123456789012345678"), (6, "ref 0000002025"),
    ], "id int, message string")
    got = {r.id: r for r in entities.with_entities(df).collect()}
    assert got[1].has_phone == 1.0
    assert got[2].accounts == [] and got[3].phones == [] and got[6].accounts == []
    assert got[4].banks == ["BBVA"] and got[4].urls == ["www.x.mx"] and got[4].amounts
    assert got[5].accounts == ["123456789012345678"]


def test_manual_features(spark):
    df = spark.createDataFrame([
        (1, "Act now!!!"), (2, "¿Cómo estás? ¿Todo bien?"), (3, "THIS Is BIG A"),
        (4, "no compartas tu password"), (5, "no one two three four five password"), (6, ""),
    ], "id int, message string")
    got = {r.id: r for r in features.with_manual_features(df).collect()}
    assert got[1].exclamation_count == 3 and got[2].question_count == 2
    assert got[3].uppercase_word_count == 2
    assert got[4].negation_score == -1.0 and got[5].negation_score == 0.0
    assert got[6].word_count == 0 and got[6].msg_length == 0


def test_evidence_of_greeting_is_empty(spark):
    df = spark.createDataFrame([("Hola cómo estás buen día",)], "message string")
    row = features.with_evidence(df).first()
    assert [row[e] for e in K.EVIDENCE] == [0] * 6


def test_filter_after_cleaning_does_not_multiply_the_plan(spark):
    df = spark.createDataFrame([("a",)], "message string")
    plan = text.clean_steps(df, "message", "c").filter(F.col("c") != "")
    assert plan.count() == 1
