"""Text cleaning as Column expressions."""

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K

# Two Unicode noncharacters, reserved for process-internal use, bracket a match
# while its digits are counted.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_ENOUGH_DIGITS = (
    rf"{_OPEN}(?:[^\p{{Nd}}{_CLOSE}]*\p{{Nd}}){{{K.PHONE_MIN_DIGITS}}}"
)


def _replace(text: Column, pattern: str, token: str) -> Column:
    return F.regexp_replace(text, pattern, token)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name ``value`` inside ``use``.

    An expression that mentions its input several times would be multiplied by
    every filter the optimizer pushes below it; here the input appears once.
    """
    return F.get(F.transform(F.array(value), use), 0)


def _when(value: Column, test: Callable[[Column], Column],
          change: Callable[[Column], Column]) -> Column:
    return let(value, lambda t: F.when(test(t), change(t)).otherwise(t))


def may_hold_url(text: Column) -> Column:
    """Every URL form has a slash or starts with www."""
    return text.contains("/") | text.rlike(r"(?i)www\.")


def may_hold_email(text: Column) -> Column:
    return text.contains("@")


def may_hold_phone(text: Column) -> Column:
    """Every phone form has three digits in a row."""
    return text.rlike(r"\p{Nd}{3}")


def may_hold_money(text: Column, marks: list[str]) -> Column:
    """Every amount names a currency; the long s folds to s when case is ignored."""
    return let(F.lower(text), lambda low: reduce(
        or_, (low.contains(m) for m in [*marks, "\u017f"])))


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, f"^{K.S}+|(?<!{K.S}){K.S}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(K.NS)


def normalize_urls(text: Column) -> Column:
    return _when(text, may_hold_url, lambda t: _replace(t, K.CLEAN_URL, K.URL_TOKEN))


def normalize_emails(text: Column) -> Column:
    return _when(text, may_hold_email, lambda t: _replace(t, K.EMAIL, K.EMAIL_TOKEN))


def mark_phones(text: Column, pattern: str) -> Column:
    return _replace(text, pattern, f"{_OPEN}$0{_CLOSE}")


def has_phone(text: Column, pattern: str = K.RULE_PHONE) -> Column:
    """A match with fewer than seven digits does not count as a phone."""
    return may_hold_phone(text) & mark_phones(text, pattern).rlike(_ENOUGH_DIGITS)


def normalize_phones(text: Column) -> Column:
    found = rf"{_ENOUGH_DIGITS}[^{_CLOSE}]*{_CLOSE}"
    return _when(text, may_hold_phone, lambda t: F.translate(
        _replace(mark_phones(t, K.CLEAN_PHONE), found, K.PHONE_TOKEN), _OPEN + _CLOSE, ""))


def normalize_money(text: Column) -> Column:
    return _when(
        text, lambda t: may_hold_money(t, K.CLEAN_MONEY_MARKS),
        lambda t: _replace(t, K.CLEAN_MONEY, K.MONEY_TOKEN))


def drop_irrelevant(text: Column) -> Column:
    return _replace(text, K.IRRELEVANT_CHARS, " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(_replace(text, f"{K.S}+", " "))


def join_relevant(text: Column) -> Column:
    """``collapse_spaces(drop_irrelevant(text))`` in one pass, which rewrites no single blank."""
    return F.trim(_replace(text, K.GAP, " "))


def words(text: Column) -> Column:
    """White-space tokens; no tokens for a blank text."""
    return F.filter(F.split(text, f"{K.S}+"), lambda w: w != "")


def clean_steps(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the cleaned text of column ``text``."""
    return df.withColumn(out, clean_text(F.col(text)))


def clean_text(text: Column) -> Column:
    """URL, e-mail, phone and money tokens, lower case, relevant characters only."""
    for step in (normalize_urls, normalize_emails, normalize_phones, normalize_money):
        text = step(text)
    return F.coalesce(join_relevant(F.lower(text)), F.lit(""))


def has_content(text: Column) -> Column:
    """True where the cleaned text will not be empty.

    Tested on the raw text: a filter on the cleaned column would be pushed below
    the cleaning steps and repeat all of them.
    """
    return text.rlike(K.RELEVANT_CHAR)


def clean_messages(df: DataFrame, text: str = "message", out: str | None = None) -> DataFrame:
    """Clean a message table without the rows that would become empty."""
    return clean_steps(df.filter(has_content(F.col(text))), text, out or text)
