"""Quality rules: fixed limits of a text, and lines that many documents of a host share.

Lines are normalised and hashed; a line found in more than a fixed number of its host's
distinct texts is frequent, however large the host, and boilerplate if so many of these
texts have words enough of their own beside their frequent lines. A document that loses
too many of its words with boilerplate is depleted and rejected. Everything is built-in
column functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let
from riskloom.session import staged

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50      # percent of words in repeated three-word windows
LINE_LEAST = 10         # distinct texts up to which a line is never boilerplate
WORDS_LEFT = 0.3        # share of its words that a document must keep


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each word counted once."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places):
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)),
                           lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeats(found):
        def marked(ordered):
            same = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.when(
                (F.get(ordered, i)["h"] == F.get(ordered, i - 1)["h"])
                | (F.get(ordered, i)["h"] == F.get(ordered, i + 1)["h"]), F.get(ordered, i)["at"]))
            return let(F.sort_array(F.array_compact(same)), covered)

        entries = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(found)) < F.size(found),
                      let(F.sort_array(entries), marked)).otherwise(0)

    return F.when(F.size(words) >= 3, let(windows, repeats)).otherwise(0)


def filled_lines(text: Column) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: Column) -> Column:
    """Hash of a line without case, digits, punctuation and the width of white space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D\p{Punct}0-9]+", " ")))


def row_key(docs: DataFrame) -> Column:
    """The same for repeated rows only."""
    return F.xxhash64(docs["doc_id"], docs["source"], docs["doc_id"].isNull(), docs["source"].isNull(), docs["text"])


def measured(docs: DataFrame) -> DataFrame:
    """Base figures and line hashes of every row; one pass over the texts."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"), row_key(docs).alias("row"))

    def figures(words):
        return F.struct(F.size(words).cast("bigint").alias("n_words"),
                        repeated_words(words).cast("bigint").alias("n_repeat_words"))

    def lines(found):
        return F.struct(
            (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("n_dup_lines"),
            F.transform(found, lambda line: F.struct(
                line_key(line).alias("h"),
                F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))).alias("lines"))

    return rows.select(
        "doc_id", "source", "row", F.xxhash64("text").alias("text_id"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(words_of(F.col("text")), figures).alias("_w"), let(filled_lines(F.col("text")), lines).alias("_l"),
    ).select("doc_id", "source", "row", "text_id", "_w.n_words", "word_chars", "n_symbols",
             "_l.n_dup_lines", "_w.n_repeat_words", "_l.lines")


def _lost(lines: Column, removed: Column) -> Column:
    """Words of the lines whose hash is among ``removed``."""
    return F.coalesce(F.aggregate(F.filter(lines, lambda line: F.array_contains(removed, line["h"])), F.lit(0),
                                  lambda total, line: total + line["words"]), F.lit(0))


def _above(single: DataFrame, least: int) -> DataFrame:
    """(source, h): lines in more than ``least`` of a source's distinct texts."""
    return single.groupBy("source", "h").agg(F.countDistinct("text_id").alias("n_docs")) \
        .filter(F.col("n_docs") > least).select("source", "h")


def _held(rows: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """(_row, ``name``): those hashes of each row's lines that stand in ``lines``."""
    single = rows.select("row", "source", F.explode("lines.h").alias("h"))
    return single.join(lines, single.source.eqNullSafe(lines.source) & (single.h == lines.h)) \
        .groupBy(single.row.alias("_row")).agg(F.collect_set(single.h).alias(name))


def judged(rows: DataFrame, least: int = LINE_LEAST, left: float = WORDS_LEFT) -> DataFrame:
    """``rows`` (staged figures) with base_failed, kept, words_left and the hashes of lines to remove.

    A text that frequent lines make up almost whole is no witness of them: a cluster of
    near copies would else pass all its own lines off as boilerplate and vanish.
    """
    often = _held(rows, _above(rows.select("source", "text_id", F.explode("lines.h").alias("h")), least), "often")
    seen = staged(rows.join(often, rows.row == often._row).dropDuplicates(["_row"]).select(
        "_row", "source", "text_id", "often",
        (F.col("n_words") - _lost(F.col("lines"), F.col("often")) >= left * F.col("n_words")).alias("witness")),
        "frequent-lines")
    removed = _held(
        seen.select(F.col("_row").alias("row"), "source", F.transform("often", lambda h: F.struct(h.alias("h"))).alias("lines")),
        _above(seen.filter("witness").select("source", "text_id", F.explode("often").alias("h")), least), "removed_lines")
    joined = rows.join(removed, rows.row == removed._row, "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return joined.withColumn("words_left", F.col("n_words") - _lost(F.col("lines"), F.col("removed_lines"))) \
        .withColumn("base_failed", failed) \
        .withColumn("kept", ~failed & (F.col("words_left") >= left * F.col("n_words"))).drop("_row", "lines")


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: figures, base_failed, kept, words_left.

    Null texts have no words and fail; null ids and null sources (one host of their own)
    are judged like others; repeated rows get equal verdicts and count once among a host's
    texts; only doc_id, source and text are read. An empty table gives an empty result.
    """
    return judged(staged(measured(docs), "lines")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "words_left")


def keep_documents(docs: DataFrame) -> DataFrame:
    """Documents that are kept, all columns, without their boilerplate lines; n_chars follows the text.

    Null and empty texts fail and go; rows with null ids or null sources are judged like
    others; repeated rows all stay or all go. An empty table gives an empty result.
    """
    verdicts = judged(staged(measured(docs), "lines")).filter("kept") \
        .select(F.col("row").alias("_row"), F.col("removed_lines").alias("_removed")).dropDuplicates(["_row"])
    joined = docs.withColumn("_key", row_key(docs)).join(verdicts, F.col("_key") == F.col("_row"))
    cleaned = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        F.split("text", "\n"),
        lambda line: ~(line.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("_removed", line_key(line)))), "\n"))
    out = joined.withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
