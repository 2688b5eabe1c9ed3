"""Small things that several operators share."""

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key):
    """True for rows that no model may learn from: crc32 of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark carry the package to its Python workers, once for an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}-code.zip"
        with zipfile.ZipFile(target, "w") as packed:
            for source in sorted(root.rglob("*.py")):
                packed.write(source, f"{root.name}/{source.relative_to(root)}")
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def row_map(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(batch) -> batch`` over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, target: str, per_class: int):
    """A bounded sample for fitting, in the driver: rows (text, label) of each class.

    Labels are read only where ``held_out`` is false. The rows with the smallest
    hash of the id are taken, at most ``per_class`` of each class.
    """
    known = (labels.filter(~held_out(F.col("doc_id"))).filter(F.col(target).isin(0, 1))
             .select("doc_id", F.col(target).cast("int").alias("_y"))
             .groupBy("doc_id").agg(F.min("_y").alias("_y")))
    picks = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
             for y in (0, 1)]
    few = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * per_class ids
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).join(few, "doc_id")
            .select("doc_id", "_t", "_y").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id", "_t").limit(2 * per_class).collect())
    return [r["_t"] for r in rows], [int(r["_y"]) for r in rows]


def let(value, body: Callable):
    """``body(value)`` with ``value`` computed once for a row, also inside inner lambdas."""
    return F.transform(F.array(value), body)[0]
