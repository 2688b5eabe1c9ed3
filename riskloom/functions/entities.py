"""Entities of a message: phones, URLs, amounts, account numbers, banks."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.text import strip

ENTITY_LISTS = ["phones", "urls", "amounts", "accounts", "banks"]
_FLAGS = {"phones": "has_phone", "urls": "has_url", "amounts": "has_amount",
          "banks": "has_bank", "accounts": "has_account"}
# A zero-padded year is not an account number.
_YEAR = r"^0*(?:19\p{Nd}{2}|20\p{Nd}{2}|2100)$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def phones(text: Column) -> Column:
    return F.transform(_all(text, K.ENTITY_PHONE), strip)


def urls(text: Column) -> Column:
    return _all(text, K.ENTITY_URL)


def amounts(text: Column) -> Column:
    return _all(text, K.ENTITY_AMOUNT)


def accounts(text: Column) -> Column:
    return F.filter(_all(text, K.ENTITY_ACCOUNT), lambda x: ~x.rlike(_YEAR))


def banks(text: Column) -> Column:
    return _all(text, K.ENTITY_BANK)


def with_entities(df: DataFrame, text: str = "message") -> DataFrame:
    """Add the five entity lists, ``entity_count`` and five 0/1 flags."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({
        "phones": phones(t), "urls": urls(t), "amounts": amounts(t),
        "accounts": accounts(t), "banks": banks(t),
    })
    count = reduce(add, (F.size(name) for name in ENTITY_LISTS))
    flags = {flag: (F.size(name) > 0).cast("double") for name, flag in _FLAGS.items()}
    return df.withColumns({"entity_count": count, **flags})
