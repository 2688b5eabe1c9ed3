"""Vocabulary matching on lower-cased text.

Every list is matched as substrings.  A chain of ``contains`` stays inside
generated code and stops at the first hit; hits of a whole list are kept as the
bits of one BIGINT, so that sets of words can be merged with OR.  ``lowered`` is
a column name or SQL expression; long chains are built as one SQL text, which is
much quicker to plan than hundreds of Column objects.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(lowered: str, vocabulary: list[str]) -> Column:
    return F.expr(" OR ".join(f"contains({lowered}, {quoted(w)})" for w in vocabulary))


def _bits(tests: list[tuple[int, str]]) -> Column:
    if not tests:
        return F.lit(0).cast("bigint")
    return F.expr(" + ".join(f"if({test}, {1 << bit}L, 0L)" for bit, test in tests))


def hit_bits(lowered: str, vocabulary: list[str]) -> Column:
    """Bit i is set when word i of the list occurs in the text."""
    return _bits([(i, f"contains({lowered}, {quoted(w)})") for i, w in enumerate(vocabulary)])


def _two_words(vocabulary: list[str]) -> list[tuple[int, str, str]]:
    phrases = [(i, w.split(" ")) for i, w in enumerate(vocabulary) if " " in w]
    if any(len(parts) != 2 for _, parts in phrases):
        raise ValueError("only phrases of two words can be matched across messages")
    return [(i, first, second) for i, (first, second) in phrases]


def head_bits(lowered: str, vocabulary: list[str]) -> Column:
    """Phrases whose second word begins the text."""
    return _bits([(i, f"startswith({lowered}, {quoted(b)})") for i, _, b in _two_words(vocabulary)])


def tail_bits(lowered: str, vocabulary: list[str]) -> Column:
    """Phrases whose first word ends the text."""
    return _bits([(i, f"endswith({lowered}, {quoted(a)})") for i, a, _ in _two_words(vocabulary)])
