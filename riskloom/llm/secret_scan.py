"""Secrets in whole texts: three fixed patterns, and windows of high entropy.

A long run of key characters is a candidate. A window slides over it; counts of its
characters change by one arriving and one leaving, and so does the sum behind the
Shannon entropy. What the patterns leave of a candidate, without dates at its head, is
a secret if its best window passes the limit of its character class and the allow-list
does not know it. Built-in column
functions only: matches are fenced by control characters and placed by running lengths.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let

# The base patterns; lengths are checked after matching.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""")
ASSIGN_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]
LEAST_VALUE, LEAST_ACCESS = 12, 18

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS = 2.8      # least entropy of a window of hexadecimal digits
MIXED_BITS = 3.7    # of a window of letters, digits and signs
# Candidates that are no secrets.
ALLOWED = [
    r"^[A-Za-z]+$",                                # words
    r"^[0-9]+$",                                   # numbers
    r"^[=_+/-]*[A-Za-z]*[=_+/-]*$",                # rules and headings
    r"^(?:[A-Za-z]+[/_=+-]+)+[A-Za-z]*$",          # paths and compound words
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(?i)0123456789|abcdefghijkl",                # alphabets
]
DATES = r"^(?:[0-9]{1,4}(?:[-/][0-9]{1,4}){2,}(?:[-/_=+]+|$))+"

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost matches, code points, end exclusive.

    Control characters in the text that serve as fences are replaced by another one,
    which no pattern here matches either.
    """
    safe = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    fenced = F.regexp_replace(safe, f"({pattern})", f"{_OPEN}$1{_CLOSE}")

    def walk(pieces):
        # every piece but the first begins with a match, then a closing fence, then plain text
        def step(state, piece):
            found = F.substring_index(piece, _CLOSE, 1)
            end = state["at"] + F.length(found)
            return F.struct(
                (state["at"] + F.length(piece) - 1).alias("at"),
                F.array_append(state["found"], F.struct(
                    state["at"].alias("start"), end.alias("end"), found.alias("found"))).alias("found"))

        begin = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"),
                         F.array().cast("array<struct<start:int,end:int,found:string>>").alias("found"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), begin, step, lambda state: state["found"])

    return F.when(text.rlike(pattern), let(F.split(fenced, _OPEN), walk)).otherwise(
        F.array().cast("array<struct<start:int,end:int,found:string>>"))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end): kind numbers the list of kinds."""
    def kept(kind, found, test):
        return F.transform(F.filter(found, test), lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.concat(
        kept(0, placed(text, ASSIGN),
             lambda m: F.length(F.regexp_replace(m["found"], ASSIGN_VALUE, "")) >= LEAST_VALUE),
        kept(1, placed(text, ACCESS), lambda m: F.length(m["found"]) >= LEAST_ACCESS),
        kept(2, placed(text, HEX), lambda m: F.lit(True))))


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def best_entropy(found: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of a string of at least ``window`` characters."""
    def over(codes):
        def step(state, i):
            fresh = F.get(codes, i)
            gone = F.when(i >= window, F.get(codes, i - window)).otherwise(-1)
            more = F.get(state["counts"], fresh)
            less = F.when(gone >= 0, F.get(state["counts"], gone)).otherwise(0)
            total = state["total"] + F.when(gone == fresh, 0.0).otherwise(
                _term(more + 1) - _term(more) + _term(less - 1) - _term(less))
            return F.struct(
                F.transform(state["counts"], lambda c, k: c + (k == fresh).cast("int") - (k == gone).cast("int"))
                .alias("counts"),
                total.alias("total"),
                F.when(i >= window - 1, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

        begin = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"),
                         F.lit(1e300).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step,
                           lambda state: F.lit(math.log2(window)) - state["least"] / window)

    codes = F.transform(F.array_remove(F.split(found, ""), ""), lambda c: F.ascii(c))
    return let(codes, over)


def stretches(m: Column, base: Column) -> Column:
    """What the base spans, ordered by start, leave of a candidate and is long enough for a window."""
    def part(start, end):
        return F.struct(start.alias("start"), end.alias("end"),
                        F.substring(m["found"], start - m["start"] + 1, end - start).alias("found"))

    def step(state, b):
        met = (b["start"] < m["end"]) & (m["start"] < b["end"])
        fits = met & (b["start"] - state["at"] >= WINDOW)
        return F.struct(
            F.when(met, F.greatest(state["at"], b["end"])).otherwise(state["at"]).alias("at"),
            F.when(fits, F.array_append(state["left"], part(state["at"], b["start"])))
            .otherwise(state["left"]).alias("left"))

    begin = F.struct(m["start"].alias("at"),
                     F.array().cast("array<struct<start:int,end:int,found:string>>").alias("left"))
    return F.aggregate(base, begin, step, lambda state: F.when(
        m["end"] - state["at"] >= WINDOW, F.array_append(state["left"], part(state["at"], m["end"])))
        .otherwise(state["left"]))


def undated(m: Column) -> Column:
    """A stretch without the dates at its head."""
    rest = F.regexp_replace(m["found"], DATES, "")
    return F.struct((m["end"] - F.length(rest)).alias("start"), m["end"].alias("end"), rest.alias("found"))


def entropy_spans(text: Column, base: Column) -> Column:
    """Stretches of high entropy, outside base spans, that the allow-list doesn't know."""
    def suspicious(m):
        found = m["found"]
        known = F.length(found) < WINDOW
        for pattern in ALLOWED:
            known = known | found.rlike(pattern)
        limit = F.when(found.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
        return F.when(~known, best_entropy(found) >= limit).otherwise(False)

    left = F.transform(F.flatten(F.transform(placed(text, CANDIDATE), lambda m: stretches(m, base))), undated)
    return F.transform(F.filter(left, suspicious), lambda m: F.struct(
        m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))


def spans_of(text: Column) -> Column:
    """Struct of base spans and all spans, each ordered by start, then kind."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(base_spans(t), lambda base: F.struct(
        base.alias("base"), F.sort_array(F.concat(base, entropy_spans(t, base))).alias("all"))))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null texts count as empty and have no spans; repeated rows stay; only doc_id and text
    are read, so other columns of any name do not matter. Empty table: empty result.
    """
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), spans_of(F.col("text")).alias("_s"))

    def of_kind(number):
        return F.size(F.filter("_s.base", lambda s: s["kind"] == number)).cast("bigint")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("_s.base")), 256).alias("base_sha256"),
                        _written(F.col("_s.all")).alias("spans"))


def masked(text: Column, mark: str = "<secret>") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    def cut(spans):
        def step(state, s):
            gap = F.greatest(s["start"] - state["at"], F.lit(0))
            fresh = s["start"] >= state["at"]
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, gap), F.lit(mark)))
                .otherwise(state["out"]).alias("out"))

        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                           lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))

    return F.when(text.isNull(), text).otherwise(let(spans_of(text)["all"], lambda spans: F.when(
        F.size(spans) > 0, cut(spans)).otherwise(text)))


def mask_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns, secrets masked; n_chars follows the text.

    Null texts stay null, empty ones empty; null ids and repeated rows stay. An empty
    table gives an empty result.
    """
    out = docs.withColumn("text", masked(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
