"""DuckDB building blocks for the SQL twins of text queries.

Patterns are written for the RE2 engine, without the look-around and the
pre-filters that the Spark side uses.
"""

from riskloom import constants as K

SPACE = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}")
S, NS, D = f"[{SPACE}]", f"[^{SPACE}]", r"\p{Nd}"
UNIT = "pesos?|dólares?|dollars?|euros?"

URL_CLEAN = (
    rf"(?i)https?://{NS}+|www\.{NS}+|bit\.ly/{NS}+|tinyurl\.com/{NS}+|t\.co/{NS}+"
    rf"|{NS}+\.(com|net|org|mx|co|io)/{NS}*")
URL_RULE = (
    rf"(?i)https?://{NS}+|www\.{NS}+|bit\.ly/{NS}+|t\.co/{NS}+|{NS}+\.(com|net|org|mx)/{NS}*")
URL_ENTITY = (
    rf"(?i)(?:https?://|www\.){NS}+"
    rf"|(?:bit\.ly|tinyurl\.com|goo\.gl|t\.co|short\.link)/{NS}+")
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_RULE = (rf"(\+?{D}{{1,3}}[{SPACE}\-.]?)?(\(?{D}{{2,4}}\)?[{SPACE}\-.]?)?"
              rf"{D}{{3,4}}[{SPACE}\-.]?{D}{{3,4}}")
PHONE_CLEAN = PHONE_RULE + rf"(?:[{SPACE}\-.]?{D}{{0,4}})?"
MONEY_CLEAN = (
    rf"(?i)(\$|€|£|¥|USD|EUR|MXN|COP|ARS|BRL){S}*[{D},.]+"
    rf"|[{D},.]+{S}*(\$|€|£|¥|USD|EUR|MXN)|\b{D}[{D},.]*{S}*({UNIT})\b")
MONEY_RULE = (
    rf"(?i)(\$|€|£|¥){S}*[{D},.]+|[{D},.]+{S}*(\$|€|£|¥)|\b{D}[{D},.]*{S}*({UNIT})\b")
AMOUNT_ENTITY = (
    rf"(?i)(?:\$|€|£|MXN|USD){S}?{D}[{D},.]*|{D}[{D},.]*{S}?(?:{UNIT})\b")
IRRELEVANT = rf"[^\p{{L}}\p{{N}}_{SPACE}!?.,<>@#$%&*+\-/]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def found(expr: str, pattern: str) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)})"


def phones(expr: str, pattern: str, on: str, off: str) -> str:
    """Visit every phone match: ``on`` for 7 digits or more, else ``off``."""
    pieces = f"string_split(regexp_replace({expr}, {q(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    digits = r"length(regexp_replace(x, '\P{Nd}', '', 'g'))"
    return (f"list_transform({pieces}, lambda x, i: CASE WHEN i % 2 = 0 AND {digits} >= 7 "
            f"THEN {on} ELSE {off} END)")


def phone_sub(expr: str) -> str:
    return f"array_to_string({phones(expr, PHONE_CLEAN, q('<PHONE>'), 'x')}, '')"


def phone_test(expr: str) -> str:
    return f"list_contains({phones(expr, PHONE_RULE, '1', '0')}, 1)"


def spaces(expr: str) -> str:
    return f"trim({sub(expr, S + '+', ' ')})"


def clean(expr: str) -> str:
    t = sub(sub(expr, URL_CLEAN, "<URL>"), EMAIL, "<EMAIL>")
    t = sub(phone_sub(t), MONEY_CLEAN, "<MONEY>")
    return spaces(sub(f"lower({t})", IRRELEVANT, " "))


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(S + '+')}), lambda w: w <> '')"


def array(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_of(low: str, vocabulary: list[str]) -> str:
    return f"list_bool_or(list_transform({array(vocabulary)}, lambda w: contains({low}, w)))"


def hits(low: str, vocabulary: list[str]) -> str:
    return f"len(list_filter({array(vocabulary)}, lambda w: contains({low}, w)))"


def count_char(expr: str, ch: str) -> str:
    return f"(length({expr}) - length(replace({expr}, '{ch}', '')))"


def case_level(score: str) -> str:
    return f"CASE WHEN {score} >= 60 THEN 'high' WHEN {score} >= 30 THEN 'medium' ELSE 'low' END"


# name of the boolean column -> expression over columns t (text) and low
FLAGS = {
    "url": f"len({found('t', URL_RULE)}) > 0",
    "phone": phone_test("t"),
    "email": match("t", EMAIL),
    "money": match("t", MONEY_RULE),
    "urgency": any_of("low", K.URGENCY_WORDS),
    "block": any_of("low", K.ACCOUNT_BLOCK_WORDS),
    "prize": any_of("low", K.PRIZE_WORDS),
    "transfer": any_of("low", K.TRANSFER_WORDS),
    "credential": any_of("low", K.CREDENTIAL_WORDS),
    "pressure": any_of("low", K.PRESSURE_WORDS),
    "money_words": f"({any_of('low', K.MONEY_WORDS)}) AND NOT {match('t', MONEY_RULE)}",
    "exclamation": f"{count_char('t', '!')} >= 3",
}


def flags_cte(source: str, name: str = "flags") -> str:
    """CTE over ``source`` (which has t and any keys) with n_urls and sig_*."""
    cols = ",\n  ".join(f"({e}) AND NOT blank AS sig_{s}" for s, e in FLAGS.items())
    return f"""{name}_low AS (SELECT *, lower(t) AS low, NOT {match('t', NS)} AS blank FROM {source}),
{name} AS (SELECT *, len({found('t', URL_RULE)}) AS n_urls,
  {cols} FROM {name}_low)"""


def scored_cte(source: str, name: str = "scored") -> str:
    points = " + ".join(
        f"CASE WHEN sig_{s} THEN {p} ELSE 0 END" for s, p in K.SIGNAL_POINTS.items())
    texts = ", ".join(
        "CASE WHEN sig_url THEN 'Contiene URL' || CASE WHEN n_urls > 1 THEN 's' ELSE '' END "
        "|| ' (' || n_urls || ')' END" if s == "url"
        else f"CASE WHEN sig_{s} THEN {q(K.SIGNAL_TEXT[s])} END"
        for s in K.SIGNAL_POINTS)
    return f"""{flags_cte(source, name + '_flags')},
{name}_points AS (SELECT *, CAST(least({points}, 100) AS INTEGER) AS risk_score,
  list_filter([{texts}], lambda x: x IS NOT NULL) AS signals FROM {name}_flags),
{name} AS (SELECT *, {case_level('risk_score')} AS risk_level FROM {name}_points)"""


DOCS = "docs AS (SELECT doc_id AS msg_id, text AS t, lang, source FROM documents)"
LABELLED = """labelled AS (SELECT d.doc_id AS msg_id, d.text AS t,
  CASE WHEN l.toxic = 1 THEN 'fraudulent' ELSE 'legitimate' END AS label
  FROM documents d JOIN labels l USING (doc_id))"""
