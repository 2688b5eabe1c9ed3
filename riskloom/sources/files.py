"""Labelled message files: delimited text with any header, several encodings."""

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.levels import lookup
from riskloom.functions.text import has_content, is_blank, strip
from riskloom.session import staged

log = logging.getLogger(__name__)
EXTENSIONS = (".csv", ".tsv", ".txt")
_LABELS = {raw: label for label, raws in K.RAW_LABELS.items() for raw in raws}


def separator(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".txt")) else ","


def _read(spark: SparkSession, path: str, header: bool, encoding: str) -> DataFrame:
    return spark.read.csv(
        path, sep=separator(path), header=header, encoding=encoding, multiLine=True,
        quote='"', escape='"')


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Read a delimited file; Latin-1 where it is not UTF-8; with or without header."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    encoding = "ISO-8859-1" if not broken.isEmpty() else "UTF-8"
    df = _read(spark, path, True, encoding)
    if df.columns:
        df = df.withColumnRenamed(df.columns[0], df.columns[0].removeprefix("﻿"))
    if text_column(df) is None and label_column(df) is None:
        bare = _read(spark, path, False, encoding)
        first = F.lower(strip(F.col(bare.columns[0]).cast("string")))
        if not bare.filter(first.isin(list(_LABELS))).isEmpty():
            names = ["label", "message"] if len(bare.columns) == 2 else [
                str(i) for i in range(len(bare.columns))]
            df = bare.toDF(*names)
    return df


def load_delimited(spark: SparkSession, paths: str, sep: str) -> DataFrame:
    """Labelled messages of many files with one header, in a single scan.

    Quoted fields may hold line breaks; a file is one task then, so large tables should
    come in many files.
    """
    rows = spark.read.csv(paths, sep=sep, header=True, multiLine=True, quote='"', escape='"', lineSep="\n",
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return drop_blank(normalize_labels(normalize_columns(rows)))


def _column(df: DataFrame, aliases: list[str]) -> str | None:
    """First alias that names a column; the order of aliases decides."""
    by_name = {c.lower().strip(): c for c in df.columns}
    return next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)


def text_column(df: DataFrame) -> str | None:
    return _column(df, K.TEXT_ALIASES)


def label_column(df: DataFrame) -> str | None:
    return _column(df, K.LABEL_ALIASES)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Project to ``(message, label)`` whatever the columns are called."""
    text, label = text_column(df), label_column(df)
    if text is None:
        raise ValueError(f"no text column among {df.columns}; expected one of {K.TEXT_ALIASES}")
    if label is None:
        raise ValueError(f"no label column among {df.columns}; expected one of {K.LABEL_ALIASES}")
    return df.select(F.col(f"`{text}`").alias("message"), F.col(f"`{label}`").alias("label"))


def normalize_labels(df: DataFrame) -> DataFrame:
    """Map label spellings to the three classes; drop rows with an unknown one."""
    known = lookup(F.lower(strip(F.col("label").cast("string"))), _LABELS)
    return df.withColumn("label", known).filter(F.col("label").isNotNull())


def drop_blank(df: DataFrame) -> DataFrame:
    return df.filter(~is_blank(F.col("message").cast("string")))


def validate(df: DataFrame) -> bool:
    for name in ("message", "label"):
        if name not in df.columns:
            raise ValueError(f"missing column {name!r}")
    if df.dropna(subset=["message", "label"]).isEmpty():
        raise ValueError("the dataset has no complete row")
    return True


def load_labelled(spark: SparkSession, path: str) -> DataFrame:
    return drop_blank(normalize_labels(normalize_columns(read_delimited(spark, path))))


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Supported files of a folder on any file system, sorted by name."""
    listing = spark.read.format("binaryFile").load(folder).select("path")
    paths = [r.path for r in listing.collect() if r.path.lower().endswith(EXTENSIONS)]
    return sorted(paths)


def load_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Union of all readable files, ``source`` = file name without extension."""
    parts = []
    paths = list_files(spark, folder)
    if not paths:
        raise FileNotFoundError(f"no csv, tsv or txt files in {folder}")
    for path in paths:
        try:
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            parts.append(load_labelled(spark, path).withColumn("source", F.lit(stem)))
        except Exception as error:  # noqa: BLE001 - a bad file is reported and skipped
            log.error("skipped %s: %s", path, error)
    if not parts:
        raise ValueError("no file could be loaded")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_message_ids(df: DataFrame, key: str = "msg_id") -> DataFrame:
    """Ids for tables that come without one: every row its own, equal rows as well.

    Numbers follow the splits of the input, so the numbered table is written once and
    read back; without the write another plan could number the rows anew.
    """
    return staged(df.withColumn(key, F.monotonically_increasing_id()), "numbered")


def save_processed(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> str:
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.format(kind).save(path)
    return path


def prepare(spark: SparkSession, folder: str, target: str, kind: str = "parquet") -> DataFrame:
    """Load, validate and write the processed table; return the written one."""
    df = load_folder(spark, folder)
    validate(df)
    save_processed(df, target, kind)
    return spark.read.csv(target, header=True, escape='"', multiLine=True) if kind == "csv" \
        else spark.read.format(kind).load(target)


def load_unlabelled(spark: SparkSession, path: str) -> DataFrame:
    """Unlabelled corpus: lines of a text file, or the text column of a table."""
    if path.lower().endswith(".txt"):
        rows = spark.read.text(path).select(strip(F.col("value")).alias("message"))
    else:
        df = read_delimited(spark, path)
        rows = df.select(F.col(f"`{text_column(df) or df.columns[0]}`").alias("message"))
    return rows.filter(has_content(F.coalesce("message", F.lit(""))))
